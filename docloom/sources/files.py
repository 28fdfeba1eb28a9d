"""File sources and sinks: catalogues of folders, text, CSV and JSON readers, and writers of datasets by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by file suffix, and how structured each format is; others are unstructured.
FORMATS = {
    "pdf": "pdf",
    "json": "json",
    "csv": "csv",
    "txt": "txt",
    "html": "html",
    "htm": "html",
    "md": "markdown",
    "markdown": "markdown",
    "docx": "docx",
    "xlsx": "xlsx",
    "xls": "xlsx",
    "xml": "xml",
}
STRUCTURED, SEMI = ("csv", "xlsx"), ("json", "xml", "html")
# Suffixes of files that may be uploaded.
UPLOADS = ["pdf", "doc", "docx", "txt", "png", "jpg", "jpeg"]


def suffix(path: Column) -> Column:
    """The last suffix in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def accepted(name: Column, size: Column, *, most: int = 10 * 1024 * 1024) -> Column:
    """Why a file is refused ('type', then 'size'), or 'accepted'."""
    return F.when(~suffix(name).isin(*UPLOADS), "type").when(size > most, "size").otherwise("accepted")


def age_class(modified: Column, now: Column) -> Column:
    """How long ago a time was, before `now`."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(modified)) / 86400
    ladder = F.when(days < 1, "current (< 1 day)").when(days < 7, "recent (< 1 week)").when(days < 30, "moderate (< 1 month)").when(days < 365, "dated (< 1 year)")
    return F.when(modified.isNull(), "unknown").otherwise(ladder.otherwise("stale (> 1 year)"))


def file_format(path: Column) -> Column:
    """Format by the suffix, in either case; null if it is not known."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.try_element_at(known, suffix(path))


def structure(form: Column) -> Column:
    return F.when(form.isin(*STRUCTURED), "structured").when(form.isin(*SEMI), "semi_structured").otherwise("unstructured")


def discover(spark: SparkSession, path: str, *, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """source_id, name, path, format, source_type, size_bytes, modified: files of known formats. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    named = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("format", file_format(F.col("path")))
    wanted = named.where("format is not null") if hidden else named.where("format is not null and not startswith(name, '.')")
    return wanted.select(F.left(F.md5("path"), F.lit(12)).alias("source_id"), "name", "path", "format", structure(F.col("format")).alias("source_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under the header's names; short rows are filled with null."""
    return spark.read.option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, *, lines: bool = True) -> DataFrame:
    """One object a line, or files that are each a list of objects or one object."""
    return spark.read.option("multiLine", not lines).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of every file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_profile(texts: DataFrame) -> DataFrame:
    """path, n_lines, n_words, n_chars, line_length, word_length, completeness of `texts` (path, text)."""
    words = F.array_remove(F.split("text", r"\s+"), "")
    sized = texts.select("path", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(words).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.length(F.array_join(words, "")).alias("letters"))
    word_length = F.when(F.col("n_words") > 0, F.round(F.col("letters") / F.col("n_words"), 6)).otherwise(0.0)
    return sized.select("path", "n_lines", "n_words", "n_chars", F.round(F.col("n_chars") / F.col("n_lines"), 6).alias("line_length"), word_length.alias("word_length"), F.when(F.col("n_words") > 0, 1.0).otherwise(0.0).alias("completeness"))


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder for each split."""
    rows.write.partitionBy(split).mode("overwrite").json(path)
