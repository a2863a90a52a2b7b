"""From raw documents to packed training sequences: five stages, each one operator of ``textloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
documents. All but the last keep the columns of ``documents``. Empty tables give empty results; rows are documents of
their own even where ids are null or repeat; texts of any length are read whole; extra columns are kept up to the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, jaccard, langid, packing, secrets
from textloom.llm.common import id_bucket, release, stage, staged_so_far
from textloom.sources.tables import table

#: Calibrated confidence below which a document's language is held to be unknown.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language the model is sure of, go."""
    model = langid.fit(docs, id_bucket("doc_id", 5) != 0)
    found = langid.predict(docs.select(F.struct("*").alias("whole"), "text"), model, ("whole",))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("whole.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are linked by a similarity of 0.8 or more, the one of least id stays."""
    return jaccard.one_of_each(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), 10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; every document stays."""
    found = secrets.redact(docs, secrets.fit(spark))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its text and its place in the packed sequences."""
    return packing.best_fit(packing.lengths(docs, texts=True))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: Learned models and searches are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), staged_so_far()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        release(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
