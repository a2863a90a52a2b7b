import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import segments


@pytest.mark.parametrize(("bits", "fan"), [(14, 10), (2, 1)])
@pytest.mark.parametrize(("reverse", "exclusive"), [(False, False), (True, True)])
def test_scans_equal_windows(spark, monkeypatch, bits, fan, reverse, exclusive):
    """One key with a third of all rows, a null key, null values; pieces of 4 rows in several levels."""
    monkeypatch.setattr(segments, "PIECE_BITS", bits)
    monkeypatch.setattr(segments, "FAN_BITS", fan)
    rng = random.Random(6)
    rows = [(rng.choice((1, 1, None, *range(2, 30))), i, rng.choice((None, None, 5, 7, -2)), "t") for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, o long, v long, t string").repartition(5)
    got = segments.scans(df, "k", ["o"], {"total": (F.col("v"), "sum"), "most": (F.col("v"), "max"), "filled": (F.col("v"), "last")}, reverse=reverse, exclusive=exclusive)
    w = Window.partitionBy("k").orderBy(F.desc("o") if reverse else F.asc("o")).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"), F.max("v").over(w).alias("most"), F.last("v", True).over(w).alias("filled"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
