import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spendframe.operators import export, jobs
from spendframe.plans import pipeline
from spendframe.sources import files
from spendframe.streaming import jobs as stream

US_TEXT = "Amazon.com Order Confirmation\nOrder #123-4567890-1234567\nOrder Placed: May 3, 2020\n2 of: Mug\n$5.00\nShipping: $1.00\nGrand Total: $11.00\n"
JP_TEXT = "注文番号: 123-4567890-7654321\n注文日: 2020年5月3日\n2 × Mug ¥1,000\n小計: ¥2,000\n配送料: ¥0\n消費税: ¥200\n合計: ¥2,200\n"


@pytest.fixture
def texts(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(US_TEXT, encoding="utf-8")
    (folder / "b.txt").write_text(JP_TEXT, encoding="utf-8")
    (folder / "c.log").write_text("not read", encoding="utf-8")
    return folder


def test_texts_are_read_whole(spark, texts):
    rows = {r.filename: r for r in files.read_texts(spark, str(texts)).collect()}
    assert set(rows) == {"a.txt", "b.txt"}
    assert rows["a.txt"].text == US_TEXT and rows["a.txt"].file_size == len(US_TEXT)


def test_stream_and_batch_extract_the_same(spark, texts, tmp_path):
    names, target = ["us", "japanese"], str(tmp_path / "out")
    stream.ingest(spark, str(texts), target, str(tmp_path / "state"), names).awaitTermination()
    batch = pipeline.extracted(files.read_texts(spark, str(texts)), names=names)
    shown = ["filename", "order_number", "order_date", "total_cents", "rule_set"]
    expected = sorted(map(tuple, batch.select(*shown).collect()))
    assert sorted(map(tuple, spark.read.parquet(target).select(*shown).collect())) == expected
    assert [r[3] for r in expected] == [1100, 220000]
    (texts / "d.txt").write_text(US_TEXT.replace("1234567\n", "1111111\n"), encoding="utf-8")
    stream.ingest(spark, str(texts), target, str(tmp_path / "state"), names).awaitTermination()
    assert spark.read.parquet(target).count() == 3


def test_live_progress_drops_repeats(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    events = [("j1", "a", True), ("j1", "a", True), ("j1", "b", False), ("j2", "c", True)]
    lines = [json.dumps({"job_id": j, "filename": f, "ts": "2024-01-01T00:00:00Z", "success": s}) for j, f, s in events]
    (folder / "e.json").write_text("\n".join(lines))
    results = stream.progress(stream.arriving_results(spark, str(folder)))
    query = results.writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True)
    query.option("checkpointLocation", stream.checkpoint_folder(spark, "live")).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.table("live").collect())
    assert got == [("j1", 2, 1, 1, 50.0), ("j2", 1, 1, 0, 100.0)]


def test_json_invoices_in_three_forms(spark, tmp_path):
    one = {"orderNumber": "1", "total": "$1.00", "items": [{"description": "Mug", "quantity": 2}]}
    for i, content in enumerate([one, [one, one], {"invoices": [one, one, one]}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(content))
    rows = files.read_invoices(spark, str(tmp_path))
    assert rows.count() == 6
    assert rows.first().vendor == "Amazon" and rows.first()["items"][0].quantity == 2


def test_writers_fail_or_overwrite(spark, tmp_path):
    frame, path = spark.createDataFrame([("a,b", 'say "x"')], "k string, v string"), str(tmp_path / "csv")
    files.write_csv(frame, path, titles={"v": "Value", "k": "Key"})
    with pytest.raises(AnalysisException):
        files.write_csv(frame, path)
    files.write_csv(frame, path, overwrite=True, titles={"v": "Value", "k": "Key"})
    back = spark.read.option("header", "true").option("escape", '"').csv(path)
    assert back.columns == ["Value", "Key"] and tuple(back.first()) == ('say "x"', "a,b")


def test_sections_and_export_records(spark, tmp_path):
    sections = spark.createDataFrame([("SUMMARY", 1), ("MONTHLY", 2)], "section string, n int")
    files.write_sections(sections, str(tmp_path / "s"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).where("section = 'SUMMARY'").count() == 1
    totals = spark.createDataFrame([("j", 1.0)], "job_id string, total double")
    records = export.job_document(totals, totals, totals)
    files.write_export(records, str(tmp_path / "e"))
    assert {r.kind for r in spark.read.json(str(tmp_path / "e")).collect()} == {"summary", "result", "error"}
    assert jobs.result_for(totals.withColumn("filename", F.lit("f")), "f").count() == 1


def test_generated_reports_are_left_out(spark):
    frame = spark.createDataFrame([("1", "Invoice Processing Report\nExport date: today"), ("2", US_TEXT)], "doc_id string, text string")
    assert [r.doc_id for r in pipeline.extracted(frame, names=["us"]).collect()] == ["2"]
