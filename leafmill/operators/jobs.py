"""Page records, job states, checkpoints and resumption, events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import pages as routing
from leafmill.operators import spelling


def spelling_warnings(corrected: Column, unresolved: Column) -> Column:
    return F.array_compact(F.array(
        F.when(corrected > 0, F.concat(F.lit("suggested_corrections:"), corrected.cast("string"))),
        F.when(unresolved > 0, F.concat(F.lit("possible_spelling_errors:"), unresolved.cast("string"))),
    ))


def spelling_unavailable(languages: Column) -> Column:
    """One warning for each language (array) that cannot be checked; to be given only where none of those requested can."""
    return F.transform(languages, lambda x: F.concat(F.lit("spellcheck_unavailable:"), x))


def unavailable(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requests (id, no, lang) without a dictionary, and whether none of the request's languages has one."""
    have = available.select(F.col("lang").alias("__lang")).distinct()
    got = requested.join(have, F.col("lang") == F.col("__lang"), "left")
    return got.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__lang").isNull(), F.struct("no", "lang")))), lambda x: x["lang"]), "+").alias("unavailable"),
        F.bool_and(F.col("__lang").isNull()).alias("none_available"),
    )


def state(records: DataFrame, keys: list[str], final: bool = True) -> DataFrame:
    """total, completed, failed pages in order, and the status of each document's page records (page, status).

    Not final: the state at a checkpoint, of the pages seen so far.
    """
    failed = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("page"))))
    out = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"), failed.alias("failed"))
    done = F.when(F.size("failed") == 0, "COMPLETED").otherwise("COMPLETED_WITH_WARNINGS")
    return out.withColumn("status", done if final else F.lit("INTERRUPTED"))


def usable(checkpoint: DataFrame, documents: DataFrame) -> DataFrame:
    """Completed pages of a checkpoint (document_path, total_pages, page, status) whose path and page count still hold."""
    now = documents.select("document_path", "total_pages")
    return checkpoint.where("status = 'completed'").join(now, ["document_path", "total_pages"])


class Run(NamedTuple):
    records: DataFrame
    states: DataFrame


#: Columns of a page record.
RECORD = ["document_path", "page", "source", "confidence", "status", "warnings", "suggested_corrections", "flagged_words"]


def run_documents(pages: DataFrame, known: DataFrame, index: DataFrame, languages: list[str], checkpoint: DataFrame | None = None, cap: int = spelling.CAP) -> Run:
    """Page records and job states of one run over pages (document_path, page, kind, text, confidence, error).

    text and confidence are a page's own or recognised ones, error is null unless the page failed. A PDF page with enough text
    is native, with confidence 1. Completed pages of a checkpoint (RECORD and total_pages) whose document has as many pages as then
    are taken over as they are; the others are processed, and one that failed keeps its error as its warning, with no
    confidence. Spelling is checked against known (word) and index (lang, word, n) in the languages that index has; if it has none of
    those requested, each gives a warning and nothing is checked. Texts are not changed.
    """
    keys = ["document_path", "page"]
    totals = pages.groupBy("document_path").agg(F.count(F.lit(1)).alias("total_pages"))
    todo, prior = pages, None
    if checkpoint is not None:
        prior = usable(checkpoint, totals).select(*RECORD)
        todo = pending(pages, prior)
    have = index.select(F.col("lang").alias("__lang")).distinct()
    asked = pages.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(languages)], "lang string")
    ready = asked.join(have, F.col("lang") == F.col("__lang"), "left_semi").agg(F.count(F.lit(1)).alias("ready"))
    routed = routing.route(todo.withColumnRenamed("confidence", "__read"))
    own = F.col("source") == "native"
    failed = F.col("error").isNotNull()
    base = routed.select(
        *keys, F.when(failed, "ocr").otherwise(F.col("source")).alias("source"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, 0.0).when(own, 1.0).otherwise(F.coalesce("__read", F.lit(0.0))).alias("confidence"),
        F.when(failed, F.array("error")).when(own, F.array().cast("array<string>")).otherwise(routing.warnings(F.coalesce("text", F.lit("")), F.coalesce("__read", F.lit(0.0)))).alias("warnings"),
    )
    found = spelling.corrected(todo.where(~failed).select(*keys, "text"), keys, known, index, languages, cap)
    item = F.struct("idx", F.col("core").alias("original"), F.col("suggestion").alias("corrected"))
    lists = found.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("suggestion").isNotNull(), item))), lambda x: F.struct(x["original"].alias("original"), x["corrected"].alias("corrected"))).alias("suggested_corrections"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("suggestion").isNull(), F.struct("idx", "core")))), lambda x: x["core"]).alias("flagged_words"),
    )
    none = lambda c, kind: F.coalesce(F.when(F.col("ready") > 0, F.col(c)), F.array().cast(kind))
    one = F.lit(1)
    full = base.join(lists, keys, "left").withColumn("__one", one).join(F.broadcast(ready.withColumn("__one", one)), "__one")  # one row
    full = full.withColumns({"suggested_corrections": none("suggested_corrections", "array<struct<original:string,corrected:string>>"), "flagged_words": none("flagged_words", "array<string>")})
    told = F.when(F.col("ready") > 0, spelling_warnings(F.size("suggested_corrections"), F.size("flagged_words"))).otherwise(spelling_unavailable(F.array(*[F.lit(x) for x in dict.fromkeys(languages)]).cast("array<string>")))
    records = full.withColumn("warnings", F.when(F.col("status") == "failed", F.col("warnings")).otherwise(F.concat("warnings", told))).select(*RECORD)
    records = records if prior is None else records.unionByName(prior)
    return Run(records, state(records, ["document_path"]))


def summarise(states: DataFrame) -> DataFrame:
    """Of job states: jobs, pages, completed and failed pages by status."""
    return states.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("pages").alias("pages"), F.sum("completed").alias("completed"), F.sum(F.size("failed")).cast("long").alias("failed"))


def stress(log: DataFrame, key: str) -> DataFrame:
    """Of logged pages (ts, memory) by run: pages, seconds, seconds a page and the peak of memory."""
    spent = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), spent.alias("seconds"), (spent / F.count(F.lit(1))).alias("seconds_per_page"), F.max("memory").alias("peak"))


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (document_path, page) still to be processed."""
    return pages.join(done.select("document_path", "page").distinct(), ["document_path", "page"], "left_anti")


def resumed(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Every page once: reused where the checkpoint has it, else processed now."""
    have = done.select("document_path", "page").distinct().withColumn("__have", F.lit(True))
    return pages.join(have, ["document_path", "page"], "left").withColumn("how", F.when(F.col("__have"), "reused").otherwise("processed")).drop("__have")


def series(records: DataFrame, key: str) -> DataFrame:
    """The checkpoint after each page: completed pages and failed ones so far."""
    upto = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.collect_list(F.when(F.col("status") == "failed", F.col("page"))).over(upto)
    return records.select(key, "page", F.count(F.when(F.col("status") == "completed", 1)).over(upto).alias("completed"), F.array_join(F.transform(failed, lambda x: x.cast("string")), ",").alias("failed"))


def events(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a run over pages (page, total, status, how): started and completed, or skipped if reused; seq orders them."""
    many = F.when(F.col("how") == "reused", F.array(F.struct(F.lit("page_skipped").alias("type"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("k")))).otherwise(
        F.array(F.struct(F.lit("page_started").alias("type"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("k")), F.struct(F.lit("page_completed").alias("type"), F.col("status").alias("status"), F.lit(1).alias("k")))
    )
    e = pages.select(*keys, "page", "total", F.explode(many).alias("e"))
    return e.select(*keys, (F.col("page") * 2 + F.col("e.k")).cast("long").alias("seq"), F.col("e.type").alias("type"), "page", "total", F.col("e.status").alias("status"))


def latest(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Of each key the last value in order, and the place of its first entry."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias("latest"), F.min(order).alias("first"))


def last_entries(log: DataFrame, key: str, order: str, n: int = 8) -> DataFrame:
    """The last n entries of each key, newest first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("nth", nth.cast("long")).where(F.col("nth") <= n)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0).cast("long")
