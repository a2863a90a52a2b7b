"""Files as documents: scan with a status a file, path resolution, and writing back with marks and line endings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Extensions of images, which are not read as text; blanks in paths that stand for a space.
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg")
PATH_BLANKS = " " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
_SPACES = str.maketrans(dict.fromkeys(PATH_BLANKS, " "))


def resolved(path: str, folder: str | None = None) -> str:
    """A user's path: a leading at-sign goes, odd blanks are spaces, ``~`` is home, and the rest is under ``folder``."""
    path = path.removeprefix("@").translate(_SPACES)
    if path == "~" or path.startswith("~/"):
        path = os.path.expanduser("~") + path[1:]
    return path if os.path.isabs(path) or "://" in path else os.path.normpath(os.path.join(folder or os.getcwd(), path))


def path_status(spark: SparkSession, path: str) -> str:
    """ok, folder, missing, denied or error: asked of the store before a plan is made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    except Exception as e:
        name = str(getattr(e, "java_exception", e))
        return "missing" if "FileNotFound" in name else "denied" if "AccessControl" in name or "Permission" in name else "error"
    return "folder" if found.isDirectory() else "ok"


def _is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGES)


def scan(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, modified, length, status (text, binary, image) and text of the files below ``folder``.

    Empty files, which the binary source leaves out, are added from the listing as empty text.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    status = F.when(_is_image(F.col("path")), "image").when(T.is_binary("content"), "binary").otherwise("text")
    read = found.select("path", F.col("modificationTime").alias("modified"), "length", status.alias("status"), F.when(status == "text", F.col("content").cast("string")).alias("text"))
    empty = _empty_files(spark, folder, glob)
    return read.unionByName(empty) if empty is not None else read


def _empty_files(spark: SparkSession, folder: str, glob: str | None) -> DataFrame | None:
    from datetime import UTC, datetime
    from fnmatch import fnmatch

    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    rows = []
    while listing.hasNext():
        f = listing.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and not name.startswith(("_", ".")) and (glob is None or fnmatch(name, glob)):
            rows.append((f.getPath().toString(), datetime.fromtimestamp(f.getModificationTime() / 1000, UTC), 0, "image" if name.rpartition(".")[2].lower() in IMAGES else "text", ""))
    return spark.createDataFrame(rows, "path string, modified timestamp, length long, status string, text string") if rows else None


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, text of text files, split like any document: ``spark.read.text`` would lose a last empty line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), T.canonical_text("value").alias("text"))
    return whole.select("path", F.posexplode(T.line_array("text")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")


def restored(text: Column | str, has_bom: Column | str, ending: Column | str) -> Column:
    """LF text with its byte order mark and its dominant line ending again."""
    c, bom, end = (F.col(x) if isinstance(x, str) else x for x in (text, has_bom, ending))
    c = F.when(end == "crlf", F.replace(c, F.lit("\n"), F.lit("\r\n"))).otherwise(c)
    return F.concat(F.when(bom, T.BOM).otherwise(""), c)


def write_texts(docs: DataFrame, folder: str, key: str = "path") -> None:
    """New versions of documents as a table of (key, text), one folder a version; files in place are never overwritten."""
    docs.select(key, "text").write.mode("errorifexists").parquet(folder)


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, modified) isn't in ``known``: what a map table has to be made again for."""
    return files.join(known.select("path", "modified"), ["path", "modified"], "left_anti")


def refreshed(files: DataFrame, known: DataFrame, build) -> DataFrame:  # noqa: ANN001
    """``known`` brought up to date: rows of unchanged files stay, the others come from ``build(files)``."""
    kept = known.join(files.select("path", "modified"), ["path", "modified"], "left_semi")
    return kept.unionByName(build(stale(files, known)))
