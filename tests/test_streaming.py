import json

from pyspark.sql import functions as F

from leafmill.streaming import progress


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    events = [{"doc_id": f"d{i % 2}", "seq": i, "type": "page_completed" if i % 2 else "page_started", "page": i // 2 % 3, "total": 3, "status": "completed" if i % 2 else None} for i in range(12)]
    table = {}
    for run, part in enumerate((events[:7], events[7:])):
        (folder / f"{run}.json").write_text("\n".join(map(json.dumps, part)))
        progress.run_once(progress.event_stream(spark, str(folder)), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        table = {(r.doc_id, r.page): (r.latest, r["first"]) for r in progress.folded(spark, str(tmp_path / "state")).collect()}
    batch = progress.fold(spark.read.schema(progress.EVENT).json(str(folder)))
    assert table == {(r.doc_id, r.page): (r.latest, r["first"]) for r in batch.collect()}


def test_only_new_pages_are_processed(spark, tmp_path):
    src = tmp_path / "pages"
    for run in range(2):
        spark.createDataFrame([(f"d{run}", 1, "text")], "doc_id string, page long, text string").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("doc_id string, page long, text string").parquet(str(src))
        progress.process_new(stream, lambda p: p.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == run + 1
