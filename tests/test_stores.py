import pytest
from pyspark.sql import functions as F

from wardline.operators.latest import latest
from wardline.sources import records
from wardline.streaming import state, stores

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def batches(spark, n=4):
    e = spark.read.parquet(f"{D}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return e, [e.where(F.col("event_id") % n == k) for k in range(n)]


def test_store_equals_latest_of_all(spark, tmp_path):
    e, parts = batches(spark)
    store = stores.LatestStore(spark, str(tmp_path / "s"), ["user_id", "event_type"], "event_id", buckets=8)
    assert store.read() is None
    for k, p in enumerate(parts):
        assert store.merge(p, k)
        seen = e.where(F.col("event_id") % 4 <= k).withColumn("_s", F.col("event_id"))
        assert rows(store.read()) == rows(latest(seen, ["user_id", "event_type"], "_s").select(*e.columns))
    first = parts[0].withColumn("_s", F.col("event_id"))
    assert rows(store.read(as_of=0)) == rows(latest(first, ["user_id", "event_type"], "_s").select(*e.columns))
    before = rows(store.read())
    assert store.tidy() and rows(store.read()) == before and not store.tidy()


def test_replayed_batch_changes_nothing(spark, tmp_path):
    _, parts = batches(spark)
    store = stores.LatestStore(spark, str(tmp_path / "s"), ["user_id"], "event_id", buckets=4)
    for k in (0, 1, 2):
        store.merge(parts[k], k)
    before = rows(store.read())
    assert not store.merge(parts[1], 1) and not store.merge(parts[3], 2)
    assert rows(store.read()) == before


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    _, parts = batches(spark)
    ok, died = (stores.LatestStore(spark, str(tmp_path / n), ["user_id"], "event_id", buckets=4) for n in ("ok", "died"))
    for s in (ok, died):
        s.merge(parts[0], 0)
    before = rows(died.read())
    with monkeypatch.context() as m:
        m.setattr(stores.Manifests, "put", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError, match="died"):
            died.merge(parts[1], 1)
    assert rows(died.read()) == before  # what was written does not count
    for s in (ok, died):
        assert s.merge(parts[1], 1)
    assert rows(died.read()) == rows(ok.read())
    assert len(died.tidy()) == 2 and rows(died.read()) == rows(ok.read())  # the first version where all its buckets are replaced, and the dead one


def test_only_touched_buckets_are_written(spark, tmp_path):
    e, _ = batches(spark)
    store = stores.LatestStore(spark, str(tmp_path / "s"), ["user_id"], "event_id", buckets=16)
    store.merge(e, 0)
    one = e.where("user_id = 1").limit(1).withColumn("event_id", F.lit(10**9).cast("long"))
    store.merge(one, 1)
    a, b = (store.manifests.read(k)["buckets"] for k in (0, 1))
    assert sum(a[k] != b[k] for k in b) == 1


def test_stream_keeps_a_store(spark, tmp_path):
    e, parts = batches(spark)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = stores.LatestStore(spark, str(tmp_path / "s"), ["user_id", "event_type"], "event_id", buckets=4)
    store.keep(stream, str(tmp_path / "c"), once=True).awaitTermination(180)
    assert len(store.manifests.batches()) == 4
    assert rows(store.read()) == rows(latest(e.withColumn("_s", F.col("event_id")), ["user_id", "event_type"], "_s").select(*e.columns))


def test_quarantine_sums_to_the_input(spark, tmp_path, monkeypatch):
    lines = [['{"a": 1}', "", "{broken", "[1]"], ['{"a": 2}', "\xff half", "7"], []]
    q = stores.Quarantine(spark, str(tmp_path / "q"))
    assert q.good() is None
    raw = F.col("line")
    for k, batch in enumerate(lines):
        df = records.parsed(spark.createDataFrame([(x,) for x in batch], "line string"), "line")
        if k == 1:
            with monkeypatch.context() as m:
                m.setattr(stores.Manifests, "put", lambda *_: (_ for _ in ()).throw(OSError("died")))
                with pytest.raises(OSError, match="died"):
                    q.put(df.drop("doc"), k, F.col("why"), raw)
        assert q.put(df.drop("doc"), k, F.col("why"), raw)
        assert not q.put(df.drop("doc"), k, F.col("why"), raw)  # sent again
    assert sorted(r.line for r in q.good().collect()) == ['{"a": 1}', '{"a": 2}']
    bad = sorted((r._reason, bytes(r._raw).decode()) for r in q.bad().collect())
    assert bad == sorted([("blank", ""), ("malformed", "\xff half"), ("malformed", "{broken"), ("not_an_object", "7"), ("not_an_object", "[1]")])
    assert q.good().count() + q.bad().count() == sum(map(len, lines))


@pytest.mark.parametrize("per_batch", [1, 2, 7])
def test_silent_bed_turns_stale_and_comes_back(spark, tmp_path, per_batch):
    heard = {"a": [0, 10, 20, 30, 40, 50, 60, 70, 200, 210], "b": list(range(0, 300, 10)), "c": [5]}
    events = sorted((t, k) for k, ts in heard.items() for t in ts) + [(400, "b"), (401, "b")]
    for i, (t, k) in enumerate(events):
        repeated = [(k, f"s{t}", 1000.0 + t), (k, f"s{t}", 1003.0 + t)]  # the same stamp again is no news
        df = spark.createDataFrame(repeated, "bed string, stamp string, s double").select("bed", "stamp", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i:03d}"))
    files = spark.readStream.schema("bed string, stamp string, ts timestamp").option("maxFilesPerTrigger", per_batch).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    out = state.staleness(files, ["bed"], "stamp", 30, "ts", late="0 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName(f"stale{per_batch}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.bed, r.at_ms // 1000 - 1000, r.status) for r in spark.table(f"stale{per_batch}").collect())
    want = [("a", 0, "first"), ("a", 100, "stale"), ("a", 200, "back"), ("a", 240, "stale"), ("b", 0, "first"), ("b", 320, "stale"), ("b", 400, "back"), ("c", 5, "first"), ("c", 35, "stale")]
    assert got == want
