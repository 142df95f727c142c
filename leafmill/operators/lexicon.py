"""Frequency tables, dictionaries and known words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn

# The count from which a language's frequent word is known; 1 for the others.
FLOORS = {"vie": 2}


def frequencies(docs: DataFrame) -> DataFrame:
    """lang, word, n: lower-cased words that consist of letters."""
    w = docs.select("lang", F.explode(fn.words(F.lower("text"))).alias("word"))
    return w.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def scores(freq: DataFrame) -> DataFrame:
    """lang, word, score: the most frequent word of N has N, the last 1; equal counts by word."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang")
    return freq.select("lang", "word", (F.count(F.lit(1)).over(whole) - F.row_number().over(order) + 1).alias("score"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """Words of dictionary lines (no, line): not the first line, what stands before a slash, letters, apostrophes, hyphens.

    Other columns, such as a language, stay.
    """
    word = F.trim(F.element_at(F.split("line", "/"), 1))
    rest = [c for c in lines.columns if c not in ("no", "line")]
    return lines.where("no > 0").select(*rest, word.alias("word")).where(F.col("word").rlike(r"^[\p{L}'-]+$"))


def word_index(dictionary: DataFrame, freq: DataFrame) -> DataFrame:
    """word, n, len: dictionary words with their frequency (of the lower-cased word, else 0), then frequent words not among them.

    If both have lang, there is an index of each language.
    """
    by = ["lang"] if "lang" in dictionary.columns and "lang" in freq.columns else []
    counted = freq.select(*[F.col(c).alias("__" + c) for c in by], F.col("word").alias("low"), "n")
    on = F.lower("word") == F.col("low")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col("__" + c))
    d = dictionary.select(*by, "word").distinct().join(counted, on, "left")
    both = d.select(*by, "word", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("rank")).unionByName(freq.select(*by, "word", "n", F.lit(1).alias("rank")))
    one = both.groupBy(*by, "word").agg(F.min_by("n", "rank").alias("n"))
    return one.withColumn("len", F.length("word").cast("long"))


def known(freq: DataFrame, dictionary: DataFrame | None = None, floors: dict[str, int] = FLOORS) -> DataFrame:
    """Words (word) of the dictionary, and frequent ones (lang, word, n) from their language's count on."""
    least = F.lit(1)
    for lang, n in floors.items():
        least = F.when(F.col("lang") == lang, n).otherwise(least)
    out = freq.where(F.col("n") >= least).select("word")
    return (out if dictionary is None else out.unionByName(dictionary.select("word"))).distinct()
