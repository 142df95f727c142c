"""The model tables, derived from the driver's tables; and the same derivations as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 3
EXTENSIONS = [".pdf", ".PNG", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".txt", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path of every document."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), ext).alias("path"))


SOURCES = f"""sources as (select doc_id, source || '/' || lang || '/doc-' || doc_id ||
  ({EXTENSIONS!r})[cast(doc_id % 10 + 1 as int)] as path from documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: documents three lines a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    cut = F.expr(f"transform(sequence(0, cast(ceil(size(l) / {LINES_PER_PAGE}) as int) - 1), i -> array_join(slice(l, i * {LINES_PER_PAGE} + 1, {LINES_PER_PAGE}), '\n'))")
    return lines.select("doc_id", F.posexplode(cut).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), "text")


PAGES = """pages_l as (select doc_id, i + 1 as page, array_to_string(l[i * 3 + 1 : i * 3 + 3], chr(10)) as text from (
  select doc_id, l, unnest(range(0, cast(ceil(len(l) / 3.0) as bigint))) as i from (
    select doc_id, string_split(text, chr(10)) as l from documents)))"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: conversations, a turn a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


DIALOGUE = "dialogue as (select conv_id as doc_id, turn + 1 as page, text from conversations)"


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: recognised words as tab-separated rows, with the faults that such files have.

    The line key is the line's index modulo 5, so that keys recur.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "t"))
    w = d.select("doc_id", "li", F.posexplode(F.regexp_extract_all("t", F.lit(r"(\S+)"), 1)).alias("wi", "w"))
    conf = F.expr("case when wi % 17 = 5 then 'n/a' else cast((doc_id * 31 + li * 7 + wi * 13) % 111 - 10 as string) end")
    word = F.expr("case when wi % 23 = 7 then ' ' else w end")
    full = F.concat_ws("\t", F.lit("5\t1\t1\t1"), F.expr("cast(li % 5 as string)"), F.col("wi").cast("string"), F.lit("0\t0\t9\t9"), conf, word)
    line = F.when(F.expr("wi % 29 = 11"), F.lit("5\t1\t1\t1\t0")).otherwise(full)
    rows = w.select("doc_id", (F.col("li") * 100000 + F.col("wi")).cast("long").alias("pos"), line.alias("line"))
    head = d.where("li = 0").select("doc_id", F.lit(-1).cast("long").alias("pos"), F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext").alias("line"))
    return head.unionByName(rows)


WORD_LINES = r"""wl_d as (select doc_id, unnest(range(0, len(l))) as li, l from (select doc_id, string_split(text, chr(10)) as l from documents)),
wl_w as (select doc_id, li, unnest(range(0, len(ws))) as wi, ws from (select doc_id, li, regexp_extract_all(l[li + 1], '\S+') as ws from wl_d)),
word_rows as (select doc_id, li * 100000 + wi as pos, 1 as block, 1 as par, li % 5 as line,
    cast((doc_id * 31 + li * 7 + wi * 13) % 111 - 10 as double) as conf, ws[wi + 1] as text
  from wl_w where wi % 29 <> 11 and wi % 23 <> 7 and wi % 17 <> 5 and (doc_id * 31 + li * 7 + wi * 13) % 111 - 10 >= 0)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, v: every embedding as an image eight pixels wide."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("e").cast("double") * 128 + 128))).cast("long")
    return e.select("image_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).cast("long").alias("y"), v.alias("v"))


PIXELS = """pixels as (select vec_id as image_id, i % 8 as x, i // 8 as y,
  cast(greatest(0, least(255, floor(cast(embedding[i + 1] as double) * 128 + 128))) as bigint) as v
  from (select vec_id, embedding, unnest(range(0, len(embedding))) as i from embeddings))"""
