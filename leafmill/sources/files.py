"""Readers of files on any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (and content) of all files under a folder, or of one file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", "content") if content else df.select("path")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """no and line of a text file, by one task: line order has a meaning here, and such files are small."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("no", "line"))


def scored_lines(lines: DataFrame) -> DataFrame:
    """word and score of a list in order of frequency: the first of N lines scores N; of a repeated word the last line counts."""
    n = lines.count()
    word = F.lower(F.trim("line"))
    return lines.select(word.alias("word"), "no", (F.lit(n) - F.col("no")).cast("long").alias("score")).groupBy("word").agg(F.max_by("score", "no").alias("score"))


def counted_lines(lines: DataFrame) -> DataFrame:
    """word and score of lines word, tab, count; others are left out."""
    f = F.split("line", "\t")
    score = F.get(f, 1).try_cast("long")
    return lines.select(F.lower(F.trim(F.get(f, 0))).alias("word"), score.alias("score"), "no").where("score is not null").groupBy("word").agg(F.max_by("score", "no").alias("score"))


def installed_languages(lines: DataFrame) -> DataFrame:
    """Codes of a language listing: not its first line, blanks or osd."""
    return lines.where("no > 0").select(F.trim("line").alias("lang")).where("lang not in ('', 'osd')")


def page_counts(info: DataFrame) -> DataFrame:
    """pages of every document from the lines of its description (path, line); null where there is none to read."""
    n = F.regexp_extract("line", r"^Pages:\s*([0-9]+)\s*$", 1).try_cast("int")
    return info.groupBy("path").agg(F.max(n).alias("pages"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and line of stored word rows."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Untouched page texts (doc_id, page, text), by document; written again, a document's pages take the place of its last ones."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)
