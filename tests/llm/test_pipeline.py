import os

import pytest

import corpus_pipeline
from leafmill.llm import queries
from leafmill.llm.scratch import saved
from tests.llm.test_text_operators import brute_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: tuple(r) for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, before, DATA), name)
        assert after.columns == columns and all(rows[r.doc_id] == tuple(r) for r in after.collect())
        if name == "near_dedup":
            want = {x[2] for x in brute_components([(r.doc_id, r.text) for r in before.collect()])}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        elif name != "mixing":
            assert after.count() >= 0.8 * before.count()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert out.count() == before.count() and out.where("not verified").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "token_output"]


def test_stages_on_odd_and_empty_rows(spark, docs, empty, corpus):
    """Nulls in every column, empty, blank and long texts, repeated rows, further columns; and no rows at all."""
    from pyspark.sql import functions as F

    odd = docs.withColumns({"kept": F.lit(1), "score": F.lit("x"), "row": F.lit(2.5), "size": F.lit(None).cast("int")})
    for start in (odd, empty):
        before = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = saved(stage(spark, before, DATA), name)
            assert after.columns == before.columns
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
            before = after
        out = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
        assert out.count() == before.count()
