"""Intermediate tables in the shared checkpoint folder, and small summaries with a proven size bound."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files go with its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="leafmill-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def drop(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files of the writing are deleted with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Largest Bloom filter in bits (16 MiB). A fuller filter only lets more rows through; an exact join always follows.
BLOOM_BITS = 1 << 27
#: Words of a filter fetched at once (32 MB).
FETCHED = 1 << 21


def bloom(hashes: DataFrame, column: str, max_bits: int = BLOOM_BITS) -> np.ndarray:
    """Bloom filter over a column of well-mixed 64-bit hashes, as an array of uint64 words.

    The bits are set by a partial aggregation on the executors, so at most max_bits / 64 rows reach the driver.
    """
    bits = 1 << 12
    wanted = min(max_bits, 12 * hashes.count())
    while bits < wanted:
        bits *= 2
    h = F.col(column)
    places = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 28).bitwiseAND(F.lit(bits - 1))))
    words = (
        hashes.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    if len(out) > FETCHED:
        words = saved(words, "bloom")
    for lo in range(0, len(out), FETCHED):
        got = words.where(F.col("w").between(lo, lo + FETCHED - 1)).toArrow()
        out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in the filter."""
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(h), dtype=bool)
    for p in (h & mask, (h >> np.uint64(28)) & mask):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out
