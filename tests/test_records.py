import json

from pyspark.sql import functions as F

from ruleloom.sources import records
from ruleloom.streaming.stages import ingest, latest


def test_meta(spark, tmp_path):
    raw = [
        {"document_number": "2024-1", "docket_ids": ["RM1"], "agencies": [{"raw_name": "RAW", "name": "Name"}, {"raw_name": "ONLY RAW"}], "type": "Rule", "action": "Final rule.", "publication_date": "2024-02-03", "cfr_references": [{"title": 18, "part": "35"}, {"title": 18}]},
        {"document_number": "2024-2", "type": "Notice", "publication_date": "never"},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, raw)))
    m = {r["doc_id"]: r for r in records.read_meta(spark, str(tmp_path / "m.json")).collect()}
    assert m["2024-1"]["agency"] == "RAW" and m["2024-1"]["agencies"] == ["Name", "ONLY RAW"] and m["2024-1"]["cfr_references"] == ["18 CFR Part 35"] and m["2024-1"]["status"] == "final"
    assert m["2024-2"]["agency"] == "" and m["2024-2"]["publication_date"] is None and m["2024-2"]["status"] == "notice" and m["2024-2"]["docket_ids"] == []
    docs = records.read_meta(spark, str(tmp_path / "m.json"))
    assert records.docket(docs, "RM1").count() == 1 and records.substantive(docs).count() == 1


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(None, "2024-1", "c1", "agree", None, None), (None, "2024-1", "c2", "maybe", None, None), (None, "", "c", "agree", None, None)], records.FEEDBACK)
    assert records.add_feedback(rows, path).count() == 2
    records.add_feedback(rows.limit(1), path)
    assert records.read_feedback(spark, path, "2024-1").count() == 2 and records.read_feedback(spark, path, "x").count() == 0


def test_ingest_gives_the_batch_result(spark, tmp_path):
    docs = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    docs.write.parquet(str(tmp_path / "in"))

    def run(batch):
        return {"latest": latest(batch, ["k"], F.col("id"), "id")}

    q = ingest(spark, str(tmp_path / "in"), "id long, k long", run, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/latest")).select("k", "id", "n").collect()))
    assert got == [(0, 18, 7), (1, 19, 7), (2, 17, 6)]
    q = ingest(spark, str(tmp_path / "in"), "id long, k long", run, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/latest")).count() == 3
