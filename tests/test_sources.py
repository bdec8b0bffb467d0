import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import dims
from wardline.sources import feeds, records, sinks, snapshots


@pytest.fixture
def folder(tmp_path):
    doc = {
        "updated_at": "2026-02-19T10:11:12+09:00",
        "beds": {
            "BED01": {"message_datetime": "2026-02-19T10:11:10+09:00", "vitals": {"HR": {"value": 75.0, "unit": "bpm"}, "RR": 16, "TSKIN": None}, "SpO2": {"value": "98"}, "HR": {"value": 1}, "note": {"x": 1}},
            "BED02": {"patient_id": "P"},
            "BED03": 5,
        },
    }
    (tmp_path / "20260219_101112_345_monitor_cache.json").write_text(json.dumps(doc))
    (tmp_path / "20260219_101112_999_before_monitor_cache.json").write_text(json.dumps({"beds": {"B": {"message_datetime": "2026-02-19T00:00:00Z"}}}))
    (tmp_path / "20260219_101113_000_monitor_cache.json").write_text("[1]")
    (tmp_path / "20260219_101114_000_monitor_cache.json").write_text("{broken")
    return str(tmp_path)


def test_snapshots(spark, folder):
    s = snapshots.load(spark, folder)
    assert s.count() == 2
    at = {r.name: r.snapshot_ts for r in s.withColumn("snapshot_ts", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss.SSS")).collect()}
    assert at["20260219_101112_345_monitor_cache.json"] == "2026-02-19 01:11:12.345"
    assert not at["20260219_101112_999_before_monitor_cache.json"].startswith("2026-02-19 01:11:12.999")
    before = {r.name: r.t for r in snapshots.load(spark, folder, before=True).select("name", F.date_format("snapshot_ts", "HH:mm:ss.SSS").alias("t")).collect()}
    assert before["20260219_101112_999_before_monitor_cache.json"] == "01:11:12.999"
    rows = {(r.bed, r.vital): r.truth for r in snapshots.truth(s).collect()}
    assert rows == {("BED01", "HR"): 75.0, ("BED01", "RR"): 16.0, ("BED01", "TSKIN"): None, ("BED01", "SpO2"): 98.0, ("BED02", None): None, ("B", None): None}
    assert ("BED02", None) not in {(r.bed, r.vital) for r in snapshots.truth(s, keep_empty_beds=False).collect()}
    times = {r.path.rpartition("/")[2]: r.t for r in snapshots.event_time(s).select("path", F.date_format("event_ts", "HH:mm:ss").alias("t")).collect()}
    assert times == {"20260219_101112_345_monitor_cache.json": "01:11:12", "20260219_101112_999_before_monitor_cache.json": "00:00:00"}


def test_current_falls_back(spark, folder):
    good = snapshots.current(spark, f"{folder}/20260219_101112_345_monitor_cache.json")
    bad = snapshots.current(spark, f"{folder}/20260219_101114_000_monitor_cache.json", previous=good)
    assert bad.count() == 1 and bad.first().doc.toJson() == good.first().doc.toJson()


def test_records(spark, tmp_path):
    rows = [
        {"capture_timestamp": "bad", "ocr_timestamp": "2026-02-19 10:00:00", "beds": {"BED01": {
            "HR": {"easy": {"value": 75, "conf": 0.9}, "tesseract": {"text": "7,6x"}}, "RR": {"candidates": [{"engine": "easyocr", "value": 1, "conf": 0.1}, {"name": "easy", "text": "12", "confidence": 0.8}, {"engine": "tess", "text": ""}]},
            "SpO2": {"text": "98", "selected_engine": "tess"}, "NO": 5, "PEEP": {"text": "--", "value": None}}}},
        {"timestamp": "2026-02-19T10:00:10Z", "beds": {}},
    ]
    (tmp_path / "r.jsonl").write_text(json.dumps(rows[0]) + "\n\n{bad\n[1,2]\n" + json.dumps(rows[1]) + "\n")
    r = records.load(spark, str(tmp_path / "r.jsonl"))
    assert r.count() == 2 and records.last_records(r, 1).count() == 1
    assert {x.why: x.n for x in records.rejected(spark, str(tmp_path / "r.jsonl")).collect()} == {"blank": 1, "malformed": 1, "not_an_object": 1}
    t = [(x.t, x.reference_key) for x in records.times(r).select(F.date_format("reference_ts", "HH:mm:ss").alias("t"), "reference_key", "line").orderBy("line").collect()]
    assert t == [("01:00:00", "ocr_timestamp"), ("10:00:10", "timestamp")]
    got = {x.field: (x.easy.value, x.easy.status, x.tess.value, x.tess.status) for x in records.engine_candidates(records.cells(r)).collect()}
    assert got["HR"] == (75.0, "valid", 76.0, "valid")
    assert got["RR"] == (12.0, "valid", None, "missing")
    assert got["SpO2"] == (None, "missing", 98.0, "valid")
    assert got["NO"][:2] == (5.0, "valid") and got["PEEP"][:2] == (None, "invalid")


def test_frames_and_feeds(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"junk\x0bMSH|one\x1c\r\x0bMSH|tw\xffo\x1c\rrest\x0bopen")
    assert [r.message for r in feeds.framed_files(spark, str(tmp_path)).orderBy("place").collect()] == ["MSH|one", "MSH|two"]
    u = feeds.uniform_feed(spark, 3)
    assert u.count() == 3 * 120 and u.join(dims.vital_dim(spark), "vital").where("value not between ref_lo and ref_hi").count() == 0
    w = feeds.walk_feed(spark, 50).toPandas()
    assert len(w) == 50 * 120
    for vital, (low, high, step) in dims.WALKS.items():
        own = w[w.vital == vital].sort_values(["bed", "tick"])
        assert own.value.between(low, high).all() and own.groupby("bed").value.diff().abs().max() <= step + 0.051


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"tolerances": {"HR": 2, "X": "no"}, "a": 1}))
    d = {"tolerances": {"HR": 1.0, "RR": 1.0}, "b": 2}
    assert feeds.settings(p, d, "shallow")["tolerances"] == {"HR": 2, "X": "no"}
    assert feeds.settings(p, d, "deep")["tolerances"] == {"HR": 2, "RR": 1.0, "X": "no"}
    assert feeds.settings(p, d, "overlay")["tolerances"] == {"HR": 2.0, "RR": 1.0}
    assert feeds.settings(tmp_path / "none", d) == d


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("B1", "HR", 75.0, "bpm", "t"), ("B1", "RR", None, "/min", "t")], "bed string, vital string, value double, unit string, time string")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert '"value":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    sinks.csv(df, str(tmp_path / "c"), "vital")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    doc = json.loads(sinks.latest_document(df).first().document)
    assert doc["B1"]["HR"]["value"] == 75.0
    sinks.replace_file("{}", tmp_path / "d" / "x.json")
    assert (tmp_path / "d" / "x.json").read_text() == "{}" and len(list((tmp_path / "d").iterdir())) == 1
    sinks.by_day(df.withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp")), "at", str(tmp_path / "days"))
    assert (tmp_path / "days" / "day=20240102").exists()
