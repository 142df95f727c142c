"""Exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(pages: DataFrame, key: str) -> DataFrame:
    """One Markdown text a document from pages (page, text), in order; a page without text is empty."""
    part = lambda x: F.concat(F.lit("<!-- page "), x["page"].cast("string"), F.lit(" -->\n\n"), x["text"], F.lit("\n\n"))
    order = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(order, part), "").alias("markdown"))


def metadata(states: DataFrame) -> DataFrame:
    """Each row as pretty JSON beside it."""
    return states.withColumn("json", F.to_json(F.struct(*states.columns), {"pretty": "true"}))


def write_metadata(states: DataFrame, key: str, path: str) -> None:
    """Each state as pretty JSON under path, by document; written again, a document's state takes the place of its last one."""
    metadata(states).select(key, "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\0").partitionBy(key).text(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """States of schema from written metadata; what cannot be read as such is left out."""
    rows = spark.read.text(path, lineSep="\0").select(F.from_json("value", schema).alias("s"))
    return rows.where("s is not null").select("s.*")


def prefixed(warnings: Column, prefix: str) -> Column:
    """What stands after the first colon in the warnings that start with prefix, distinct."""
    return F.array_distinct(F.transform(F.filter(warnings, lambda w: F.startswith(w, F.lit(prefix))), lambda w: F.element_at(F.split(w, ":"), 2)))


def write_markdown(pages: DataFrame, key: str, path: str) -> None:
    """Markdown texts as files under path, by document."""
    markdown(pages, key).write.option("lineSep", "\0").partitionBy(key).text(path)


def collisions(paths: DataFrame, stem: Column) -> DataFrame:
    """Output names that several paths share."""
    return paths.groupBy(stem.alias("stem")).agg(F.countDistinct("path").alias("paths"), F.min("path").alias("first")).where("paths > 1")
