from pyspark.sql import functions as F

from wardline.operators import latest, readings
from wardline.streaming import state

D = "/root/testdata/sf0.001"


def feed(spark, tmp_path, parts=3):
    e = spark.read.parquet(f"{D}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    n = e.count()
    for k in range(parts):  # in order of arrival
        e.where((F.col("event_id") >= k * n // parts) & (F.col("event_id") < (k + 1) * n // parts)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(str, df.collect()))


def test_latest_equals_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    keys = ["user_id", "event_type"]
    add = lambda df: df.drop("ts").withColumn("seq", F.col("event_id"))
    assert rows(run(state.latest(add(stream), keys, "seq"), "complete", tmp_path, "latest")) == rows(latest.latest(add(batch), keys, "seq"))


def test_hold_last_equals_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    keys = ["user_id", "event_type"]
    got = run(state.hold_last(stream, keys, "event_id", "value"), "append", tmp_path, "held").select("event_id", "held", "imputed")
    want = readings.hold_last(batch, keys, "event_id", "value").select("event_id", "held", "imputed")
    assert rows(got) == rows(want)


def test_windows_counters_and_batches(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    w = run(state.windowed(stream, "ts", ["event_type"], "value", late="1 day"), "update", tmp_path, "windows")
    assert w.groupBy("window", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == batch.count()
    assert rows(run(latest.running_missing(stream, "event_type", "value"), "complete", tmp_path, "counters")) == rows(latest.running_missing(batch, "event_type", "value"))
    seen = []
    state.each_batch(state.deduplicated(stream, "ts", ["event_id"]), lambda df, k: seen.append(df.count()), str(tmp_path / "each"), once=True).awaitTermination(120)
    assert sum(seen) == batch.count()
