"""Extensions that the reference only plans: headings, chapters, error rates, model and artifact choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heading idioms by language.
HEADINGS = [
    ("en", r"^(CHAPTER|Chapter|Part|PART) +([0-9]+|[IVXLC]+)\b"), ("vi", r"^(Chương|CHƯƠNG|Phần) +([0-9]+|[IVXLC]+)\b"),
    ("ja_zh", r"^第[0-9一二三四五六七八九十百]+[章节節部]"), ("numbered", r"^[0-9]+(\.[0-9]+)*\.? +\p{Lu}"),
]


def heading(line: Column) -> Column:
    """The kind of heading that a line reads like, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def chapters(lines: DataFrame, key: str) -> DataFrame:
    """Lines (no, line, heading) with the chapter they belong to; 0 before the first heading."""
    upto = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("chapter", F.sum(F.col("heading").cast("int")).over(upto))


def character_error_rate(read: Column, truth: Column) -> Column:
    return F.levenshtein(read, truth) / F.greatest(F.lit(1), F.length(truth))


#: The code point that stands for the first of a pair's words.
FIRST_CODE = 0x4E00


def word_error_rate(read: Column, truth: Column) -> Column:
    """Edit distance over words: each different word of a pair is stood for by a code point of its own.

    A text without words has none. A pair of more different words than there are code points from FIRST_CODE on (1,092,096) gives null.
    """
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    a, b = words(read), words(truth)
    both = F.array_distinct(F.concat(a, b))

    def coded(words: Column) -> Column:
        point = lambda w: F.array_position(both, w) + (FIRST_CODE - 1)
        skip = lambda p: F.when(p < 0xD800, p).otherwise(p + 0x800)  # noqa: E731  surrogates are no code points
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(skip(point(w))), 8, "0")), "UTF-32")
        return F.array_join(F.transform(words, code), "")

    rate = F.levenshtein(coded(a), coded(b)) / F.greatest(F.lit(1), F.size(b))
    return F.when(F.size(both) <= 0x110000 - 0x800 - FIRST_CODE, rate)


def chapter_names(lines: DataFrame, key: str) -> DataFrame:
    """Folder (NN_Title) and text of each chapter (0: what stands before the first) of lines (no, line, heading)."""
    one = chapters(lines, key).groupBy(key, "chapter").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    title = F.regexp_replace(F.regexp_replace(F.get("l", 0)["line"], r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    title = F.when(F.col("chapter") == 0, "Front").when(title == "", "Chapter").otherwise(F.substring(title, 1, 60))
    return one.select(key, "chapter", F.format_string("%02d_%s", F.col("chapter").cast("int"), title).alias("folder"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def write_chapters(lines: DataFrame, key: str, path: str) -> None:
    """Chapters as files under path, by document and folder."""
    chapter_names(lines, key).select(key, "folder", "text").write.option("lineSep", "\0").partitionBy(key, "folder").text(path)


# Weights of the text signal and of the layout signals, and the least vote for a heading and for asking further.
TEXT_WEIGHT, LAYOUT_WEIGHT = 0.6, 0.4
HEADING_VOTE, ASK_LAYOUT = 0.8, 0.75


def layout(lines: DataFrame, key: str) -> DataFrame:
    """lines (no, line) with layout: the share of signals that a heading gives (short, no stop at its end, a blank line or nothing before, none after a letter in lower case)."""
    order = Window.partitionBy(key).orderBy("no")
    before = F.trim(F.coalesce(F.lag("line").over(order), F.lit("")))
    signals = [F.length("line") <= 60, ~F.col("line").rlike(r"[.,;:!?]\s*$"), before == "", F.col("line").rlike(r"^\s*[\p{Lu}\p{N}]")]
    return lines.withColumn("layout", sum((s.cast("double") for s in signals), F.lit(0.0)) / len(signals))


def vote(lines: DataFrame) -> DataFrame:
    """lines (heading, layout) with vote and route: heading, ask (a layout like a heading's without the wording), or body."""
    said = F.col("heading").isNotNull()
    v = TEXT_WEIGHT * said.cast("double") + LAYOUT_WEIGHT * F.col("layout")
    route = F.when(v >= HEADING_VOTE, "heading").when(~said & (F.col("layout") >= ASK_LAYOUT), "ask").otherwise("body")
    return lines.withColumns({"vote": v, "route": route})


def model_tier(ram_gb: Column, vram_gb: Column) -> Column:
    """The pseudo-code's rule: 8 GB of video memory for Large, 16 GB of memory for Medium, else Small."""
    return F.when(vram_gb >= 8, "Large").when(ram_gb >= 16, "Medium").otherwise("Small")


def preflight(needed: Column, free: Column) -> Column:
    """Whether an artifact of known size may be fetched, with the figures to show: ok, required, available, short."""
    short = F.greatest(F.lit(0), needed - free)
    return F.struct((needed <= free).alias("ok"), needed.alias("required"), free.alias("available"), short.alias("short"))


def backoff(attempt: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before a try is repeated: twice as long each time, up to a bound; attempt counts from 0."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt))
