"""Every registered query with a DuckDB equivalent, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from leafmill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return plain(v.item()) if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert mine
        return
    rel = db.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_suggestions_come_from_the_whole_pool(spark, tmp_path):
    """The right candidates rank after 3,100 more frequent words; two languages have words of their own."""
    rest = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(3)) + "qqqqqqqq" for i in range(3100))
    docs = [(i, f"{rest} {rest}", lang) for i, lang in enumerate(("en", "es", "fr"))] + [(3, "jumpingly jumpingly", "en"), (4, "cañónico cañónico", "es"), (5, "vérifions vérifions", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "some jumpingli here")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.core: r.corrected for r in catalogue.QUERIES["correct_text_capped"](spark, str(tmp_path)).collect()}
    assert got["jumpingli"] == "jumpingly"
    found = {(r.lang, r.word): r.suggestion for r in catalogue.QUERIES["suggest_confusable"](spark, str(tmp_path)).collect()}
    assert found["es", "cañònico"] == "cañónico" and found["fr", "vèrifions"] == "vérifions"


@pytest.mark.parametrize("name", ["correct_text_capped", "suggest_confusable"])
def test_documents_are_not_counted_again_and_again(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 1
