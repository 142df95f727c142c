import re
import time

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import scratch, textscan


def test_filter_holds_all_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FETCHED", 100)
    df = spark.range(3000).select(F.xxhash64("id").alias("k"))
    words = scratch.bloom(df, "k")
    keys = df.toArrow()["k"].to_numpy().view(np.uint64)
    other = np.random.default_rng(0).integers(0, 2**63, 50_000, dtype=np.uint64)
    assert scratch.in_bloom(words, keys).all() and scratch.in_bloom(words, other).mean() < 0.1
    full = scratch.bloom(df, "k", max_bits=1 << 12)  # too small: it lets more through, and loses nothing
    assert len(full) == 64 and scratch.in_bloom(full, keys).all()


def test_tables_lie_in_the_shared_folder(spark):
    df = scratch.saved(spark.range(5), "some")
    assert df.inputFiles()[0].startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_shuffle_files_go_with_the_writing(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in re.findall(r"shuffle_\d+_", disk.getAllFiles().mkString(" "))}
    before, df = held(), spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).count()
    got, until = scratch.saved(df, "some"), time.monotonic() + 10
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not held() - before and got.count() == 999 == df.count()
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP, "false") == "false"


def test_fingerprints_depend_on_content_alone():
    import pyarrow as pa

    texts = ["ab cd ab", "cd", "", None, "ab  cd\tab"]
    w = [textscan.words(b) for b in textscan.blocks(pa.array(texts), 8)]
    hashes = np.concatenate([x.hash for x in w]).tolist()
    assert hashes[0] == hashes[2] == hashes[4] == hashes[6] and hashes[1] == hashes[3] == hashes[5] and hashes[0] != hashes[1]
    assert [len(x.hash) for x in w] == [3, 1, 3]
