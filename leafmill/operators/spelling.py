"""Unknown words and suggestions for them. Texts are never changed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.functions.edits import EDIT, EDITS, edit_cost, folded, keyed
from leafmill.scratch import bloom, saved

# Suggestions and flagged words kept of a page, and the languages whose confusable letters are cheap.
CAP = 50
CONFUSED = ("vie",)
#: Largest Bloom filter over the words' deletion keys, in bits (64 MiB); a fuller one lets more of the index's keys through.
KEY_BITS = 1 << 29


def tokens(pages: DataFrame, keys: list[str], shape: Column | None = None) -> DataFrame:
    """keys, idx and core of every word of pages' text; shape: another column of `word`."""
    w = pages.select(*keys, F.posexplode(fn.words(F.col("text"))).alias("idx", "word"))
    return w.select(*keys, F.col("idx").cast("long").alias("idx"), (fn.core(F.col("word")) if shape is None else shape).alias("core"))


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens (core) of more than one character that are not among known words (word).

    A token is known as it stands, in lower case, or, if it is in upper case, as any of a word's spellings; a word with capitals of
    its own is not known without them.
    """
    low = F.lower("word")
    forms = known.groupBy(low.alias("__low")).agg(F.bool_or(F.col("word") == low).alias("__plain"), F.collect_set("word").alias("__forms"))
    spelled = F.array_contains("__forms", F.col("core")) | ((F.upper("core") == F.col("core")) & F.array_contains(F.transform("__forms", F.upper), F.col("core")))
    got = found.where(F.length("core") > 1).join(forms, F.lower("core") == F.col("__low"), "left")
    return got.where(~F.coalesce(F.col("__plain") | spelled, F.lit(False))).select(*found.columns)


def flaggable(found: DataFrame, known: DataFrame) -> DataFrame:
    """Trimmed tokens (core) of more than one character, not of ASCII digits alone, that are not known."""
    return unknown(found.where(~F.col("core").rlike("^[0-9]+$")), known)


def candidates(words: DataFrame, index: DataFrame, lang: str = CONFUSED[0], confused: tuple[str, ...] | None = CONFUSED) -> DataFrame:
    """word (and lang, if words have it), candidate, cost and ranking of every index word within a word's greatest cost.

    words (word) are distinct, index has word and n; both may have lang, else they are of the language given. Confusable
    changes are cheap in the languages confused, in all if that is None. Both are written to the shared folder first.
    """
    return _priced(_kept(words), _kept(index, "n"), lang, confused)


def _kept(rows: DataFrame, *more: str) -> DataFrame:
    """The words (lang, if rows have it, word and more) that are not empty, as a table of the shared folder."""
    by = ["lang"] if "lang" in rows.columns else []
    return saved(rows.select(*by, "word", *more).where("word <> ''"), "words")


def _allowed(low: Column) -> Column:
    """Edits within a word's greatest cost."""
    return (fn.max_cost(low) / EDIT).cast("int")


def _priced(words: DataFrame, index: DataFrame, lang: str, confused: tuple[str, ...] | None, tier: int | None = None) -> DataFrame:
    """candidates() of tables; with tier, only those within tier edits, of the words that may have that many.

    Words meet on deletion keys of high cardinality (see edits.deletion_keys), confusable letters folded where they are cheap,
    so that no pair within reach is lost; each pair that meets is then priced once. Of the index's keys, only those that may
    be among the words' leave the worker that makes them: a bounded Bloom filter tells, and the join is exact.
    """
    spark = words.sparkSession  # few rows with much work each: as many partitions as there is to run them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low, own = F.lower("word"), lambda df: F.col("lang") if "lang" in df.columns else F.lit(lang)
    cheap = F.lit(True) if confused is None else F.col("lang").isin(*confused)
    bare = F.when(cheap, folded(F.col("low"))).otherwise(F.col("low"))
    side = lambda df, *more: df.select(own(df).alias("lang"), "word", low.alias("low"), *more).where("low <> ''").withColumns(
        {"id": F.xxhash64("lang", "word"), "salt": F.xxhash64("lang"), "bare": bare})
    w, c = side(words).withColumn("edits", _allowed(F.col("low"))), side(index, "n")
    size = F.length("low")
    if tier is None:
        sizes = (size <= 4, size.between(2, 8), size >= 4)
        reached = F.explode(F.filter(F.array(*[F.when(near, k) for k, near in zip(range(1, EDITS + 1), sizes, strict=True)]), lambda k: k.isNotNull()))
    else:
        w, c = w.where(F.col("edits") >= tier).withColumn("edits", F.lit(tier)), c.where((size >= (1, 2, 4)[tier - 1]))
        reached = F.lit(tier)
    asked = keyed(w.repartition(parts, "id").select("id", "salt", F.col("bare").alias("word"), "edits"))
    wanted = bloom(asked, "key", KEY_BITS)
    offered = keyed(c.repartition(parts, "id").select("id", "salt", F.col("bare").alias("word"), reached.alias("edits")), wanted)
    # a word makes up to some 300 rows, which its table's size does not show: neither side may be broadcast by that
    met = asked.select(F.col("id").alias("wid"), "key", F.col("own").alias("longer")).hint("merge").join(offered.hint("merge"), "key").where("longer or own")
    met = met.select("wid", F.col("id").alias("cid")).repartition(parts, "wid").distinct()
    near = met.join(w.select(F.col("id").alias("wid"), "lang", "word", F.col("low").alias("wl"), "edits"), "wid")
    near = near.join(c.select(F.col("id").alias("cid"), F.col("lang").alias("cl_lang"), F.col("word").alias("candidate"), F.col("low").alias("cl"), "n"), "cid")
    gap = F.abs(F.length("cl") - F.length("wl"))
    near = near.where(F.col("lang").eqNullSafe(F.col("cl_lang")) & (gap <= F.col("edits")))
    priced = near.withColumn("cost", edit_cost(F.col("wl"), F.col("cl"), F.coalesce(cheap, F.lit(False)), (tier or EDITS) * EDIT)).where(F.col("cost") <= F.col("edits") * EDIT)
    other = F.substring("wl", 1, 1) != F.substring("cl", 1, 1)
    return priced.select(*(["lang"] if "lang" in words.columns else []), "word", "candidate", "cost", "n", other.alias("other_first"), gap.alias("gap"), (F.col("cl") != F.col("candidate")).alias("caps"))


def suggest(words: DataFrame, index: DataFrame, lang: str = CONFUSED[0], confused: tuple[str, ...] | None = CONFUSED) -> DataFrame:
    """word, suggestion and cost (lang too, if words have it): best() over all candidates of the whole index.

    The cost comes first in the order, so a word that has a candidate within one edit needs none within two, and so on: each
    tier's search is for the words that the tiers before left without one.
    """
    left, index, tiers = _kept(words), _kept(index, "n"), []
    by = [c for c in ("lang", "word") if c in left.columns]
    for tier in range(1, EDITS + 1):
        tiers.append(saved(_least(_priced(left, index, lang, confused, tier)), "tier"))
        if tier < EDITS:
            got = tiers[-1].select(*[F.col(c).alias("__" + c) for c in by])
            same = [F.col(c).eqNullSafe(F.col("__" + c)) for c in by]
            left = saved(left.where(_allowed(F.lower("word")) > tier).join(got, same, "left_anti"), "words")
            if left.isEmpty():
                break
    return _named(functools.reduce(DataFrame.unionByName, tiers))


def best(priced: DataFrame) -> DataFrame:
    """Each word's least candidate by cost, frequency, first letter, length, capitals, then the word itself.

    Where the least is the word itself (cost 0) there is no suggestion, whatever else is near.
    """
    return _named(_least(priced))


def _least(priced: DataFrame) -> DataFrame:
    key = F.struct("cost", (-F.col("n")).alias("f"), "other_first", "gap", "caps", "candidate")
    return priced.groupBy(*[c for c in ("lang", "word") if c in priced.columns]).agg(F.min(key).alias("k"))


def _named(least: DataFrame) -> DataFrame:
    return least.where("k.cost > 0").select(*least.columns[:-1], F.col("k.candidate").alias("suggestion"), F.col("k.cost").cast("long").alias("cost"))


def first_language(found: DataFrame, languages: list[str]) -> DataFrame:
    """Of suggestions by language: lang_no, suggestion and cost of the first language, in order of request, that has one."""
    order = F.create_map(*[F.lit(x) for i, lang in enumerate(dict.fromkeys(languages)) for x in (lang, i)])
    one = found.withColumn("lang_no", F.try_element_at(order, F.col("lang")).cast("long")).where("lang_no is not null")
    return one.groupBy("word").agg(F.min(F.struct("lang_no", "suggestion", "cost")).alias("k")).select("word", "k.*")


def capped(found: DataFrame, page: list[str], cap: int = CAP) -> DataFrame:
    """First sightings (page, idx, core, suggestion or null) up to where either kind reaches the cap on its page."""
    one = found.groupBy(*page, "core").agg(F.min("idx").alias("idx"), F.first("suggestion").alias("suggestion"))
    kind = F.col("suggestion").isNull()
    nth = F.row_number().over(Window.partitionBy(*page, kind).orderBy("idx"))
    numbered = one.withColumn("nth", nth)
    stop = F.min(F.when(F.col("nth") == cap, F.col("idx"))).over(Window.partitionBy(*page))
    return numbered.withColumn("stop", stop).where("stop is null or idx <= stop").drop("stop", "nth")


def flagged(found: DataFrame, page: list[str], cap: int = CAP) -> DataFrame:
    """First sightings (page, idx, core) of unknown tokens, at most cap a page and at least one."""
    one = found.groupBy(*page, "core").agg(F.min("idx").alias("idx"))
    nth = F.row_number().over(Window.partitionBy(*page).orderBy("idx"))
    return one.withColumn("nth", nth).where(F.col("nth") <= max(cap, 1)).drop("nth")


def corrected(pages: DataFrame, keys: list[str], known: DataFrame, index: DataFrame, languages: list[str], cap: int = CAP) -> DataFrame:
    """keys, idx, core and suggestion (null if none, else in the core's case) of pages' (keys, text) unknown words, capped.

    index (lang, word, n) has every language's words; the first of languages with a suggestion names it.
    """
    found = saved(unknown(tokens(pages, keys), known), "unknown")
    words = found.select(F.col("core").alias("word")).distinct()
    each = words.select(F.explode(F.array(*map(F.lit, dict.fromkeys(languages)))).alias("lang"), "word")
    named = first_language(suggest(each, index.where(F.col("lang").isin(*languages))), languages)
    met = found.join(named.select(F.col("word").alias("core"), "suggestion"), "core", "left")
    return capped(met, keys, cap).select(*keys, "idx", "core", fn.match_case(F.col("core"), F.col("suggestion")).alias("suggestion"))
