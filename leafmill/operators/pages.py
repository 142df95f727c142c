"""Discovery, routing and recognised text of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn


def discover(paths: DataFrame) -> DataFrame:
    """Supported files with their kind (path, kind); order by natural_key for the reading order."""
    return paths.withColumn("kind", fn.classify(F.col("path"))).where("kind is not null")


def naturally(paths: DataFrame) -> DataFrame:
    """Paths in natural order, equal keys by path; a range-partitioned sort."""
    return paths.orderBy(fn.natural_key(F.col("path")), "path")


def route(pages: DataFrame) -> DataFrame:
    """source (native or ocr) and confidence of pages (kind, text): a PDF page with enough text is taken as it is."""
    own = (F.col("kind") == "pdf") & fn.native(F.col("text"))
    return pages.withColumn("source", F.when(own, "native").otherwise("ocr")).withColumn("confidence", F.when(own, F.lit(1.0)))


def parse_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """Word rows (block, par, line, conf, text) from tab-separated lines; headers, short rows, noise and blanks go."""
    f = F.split(line, "\t", -1)
    number = lambda i: F.coalesce(F.get(f, i).try_cast("int"), F.lit(0)).cast("long")
    conf = F.coalesce(F.get(f, 10).try_cast("double"), F.lit(-1.0))
    rows = lines.where((F.size(f) >= 12) & (F.get(f, 0) != "level")).where((conf >= 0) & (F.trim(F.get(f, 11)) != ""))
    keep = [c for c in lines.columns if c != line]
    return rows.select(*keep, number(2).alias("block"), number(3).alias("par"), number(4).alias("line"), conf.alias("conf"), F.get(f, 11).alias("text"))


def lines_of(words: DataFrame, page: list[str]) -> DataFrame:
    """Lines (line_no, text, words, conf) of word rows in order of pos: a line lasts while its key stays the same."""
    order = Window.partitionBy(*page).orderBy("pos")
    key = F.struct("block", "par", "line")
    new = F.coalesce((key != F.lag(key).over(order)).cast("int"), F.lit(1))
    runs = words.withColumn("__new", new).withColumn("line_no", F.sum("__new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy(*page, "line_no").agg(text.alias("text"), F.count(F.lit(1)).alias("words"), F.sum("conf").alias("conf"))


def page_result(lines: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """text and confidence of every page; a page without words has no text and confidence 0."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    mean = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("conf") / F.sum("words") / 100))
    got = lines.groupBy(*page).agg(text.alias("text"), mean.alias("confidence"))
    return pages.select(*page).distinct().join(got, page, "left").select(*page, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def page_texts(words: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """The same from word rows in one shuffle: a page's words meet as one array in order of pos, empty for a page without any."""
    word = F.struct("pos", "block", "par", "line", "conf", "text")
    rows = words.select(*page, word.alias("w"))
    rows = rows.unionByName(pages.select(*page, F.lit(None).cast(rows.schema["w"].dataType).alias("w")))
    got = rows.groupBy(*page).agg(F.array_sort(F.collect_list("w")).alias("w"))
    key = lambda x: F.struct(x["block"], x["par"], x["line"])
    gap = lambda x, i: F.when(i == 0, "").when(key(x) == key(F.get("w", i - 1)), " ").otherwise("\n")
    text = F.array_join(F.transform("w", lambda x, i: F.concat(gap(x, i), x["text"])), "")
    mean = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["conf"]) / F.size("w") / 100
    sure = F.when(F.size("w") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))
    return got.select(*page, text.alias("text"), sure.alias("confidence"))


def warnings(text: Column, confidence: Column) -> Column:
    low = F.when(confidence < 0.5, "low_confidence")
    return F.array_compact(F.array(low, F.when(F.trim(text) == "", "no_text_detected")))


def resolve_language(selection: Column, installed: Column) -> Column:
    """An explicit choice as it is; else all that is installed, joined by plus; else eng."""
    explicit = selection.isNotNull() & ~selection.isin("", "auto")
    return F.when(explicit, selection).when(F.size(installed) > 0, F.array_join(installed, "+")).otherwise("eng")


def split_languages(joined: Column) -> Column:
    return F.filter(F.transform(F.split(joined, r"\+"), lambda x: F.trim(x)), lambda x: x != "")
