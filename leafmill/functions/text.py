"""Column functions on paths, words and texts; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension, and the least visible characters of a page whose own text is used.
PDF = ("pdf",)
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
NATIVE_CHARS = 20


def extension(path: Column) -> Column:
    """Lower-cased last extension of a path's last part; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([A-Za-z0-9]+)$", 1))


def classify(path: Column) -> Column:
    """pdf, image, or null for what is not supported."""
    ext = extension(path)
    return F.when(ext.isin(*PDF), "pdf").when(ext.isin(*IMAGES), "image")


def natural_key(path: Column) -> Column:
    """Sort key: runs of digits by value and digit count, other runs lower-cased; text stands before numbers."""
    def part(x: Column) -> Column:
        digits = x.rlike("^[0-9]+$")
        top = F.lit("18446744073709551615").cast("decimal(20,0)")
        significant = F.regexp_replace(x, "^0+", "")
        value = F.when(F.length(significant) > 20, top).otherwise(F.least(top, F.coalesce(significant.try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))))
        return F.struct(
            F.when(digits, 1).otherwise(0).alias("k"), F.when(digits, "").otherwise(F.lower(x)).alias("t"),
            F.when(digits, value).otherwise(F.lit(0).cast("decimal(20,0)")).alias("n"), F.when(digits, F.length(x)).otherwise(0).alias("l"),
        )

    return F.transform(F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), 1), part)


def visible(text: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]", ""))


def native(text: Column) -> Column:
    """Whether a page's own text is taken as it is."""
    return visible(text) >= NATIVE_CHARS


def match_case(original: Column, suggestion: Column) -> Column:
    """suggestion with the case of original: upper if every letter is (one without case is not), first upper, or as it is."""
    upper = original.rlike(r"\p{IsAlphabetic}") & ~original.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")
    title = original.rlike(r"^\p{IsUppercase}")
    return F.when(upper, F.upper(suggestion)).when(title, F.concat(F.upper(F.substring(suggestion, 1, 1)), F.substring(suggestion, 2, 1 << 30))).otherwise(suggestion)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), 1)


def pieces(text: Column) -> Column:
    """Runs of white space and runs without, in order; they join to the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\s+|\S+)"), 1)


def core(word: Column) -> Column:
    """From a word's first letter to its last; empty without a letter."""
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}]+", ""), r"[^\p{L}]+$", "")


def trimmed(word: Column) -> Column:
    """A word without what is neither letter nor digit at its ends."""
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def max_cost(word: Column) -> Column:
    """The dearest suggestion for a word: 10 up to three letters, 20 up to six, else 30."""
    return F.when(F.length(word) <= 3, 10).when(F.length(word) <= 6, 20).otherwise(30)


def page_name(page: Column) -> Column:
    return F.format_string("page-%03d", page)


def stem(path: Column) -> Column:
    """The last part without its last extension; `document` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""), F.lit("")), F.lit("document"))


def gigabytes(size: Column) -> Column:
    """GiB with one decimal; halves go to the even digit, as C and DuckDB print them (format_string would take them up)."""
    tenths = F.rint(size / F.lit(1073741824.0) * 10)
    return F.when(size.isNotNull(), F.format_string("%.1f GB", tenths / 10))
