"""Queries that run a stream over a whole table, to its end, and give what it leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import records
from ..streaming import state, stores
from .registry import query, table


def _stream(spark, d: str, name: str) -> DataFrame:
    # A pattern, so that a table may be one file as well as a folder of them.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _ended(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("select user_id, event_type, max(event_id) event_id, arg_max(ts, event_id) ts, arg_max(value, event_id) \"value\" from events group by all")
def latest_store_stream(spark, d):
    """The latest event of each user and type, merged batch by batch into a store."""
    root = state.shared_folder(spark)
    store = stores.LatestStore(spark, f"{root}/store", ["user_id", "event_type"], "event_id")
    _ended(store.keep(_stream(spark, d, "events").drop("props"), f"{root}/checkpoint", once=True))
    return store.read().select("user_id", "event_type", "event_id", "ts", "value")


@query("""with l as (select case when event_id % 13 = 0 then '' when event_id % 11 = 0 then left(props, 5) when event_id % 7 = 0 then '[' || event_id || ']' else props end line, event_id % 13 = 0 blank, event_id % 11 = 0 cut, event_id % 7 = 0 list from events)
  select case when blank then 'blank' when cut then 'malformed' when list then 'not_an_object' else 'good' end reason, count(*) n, sum(strlen(line))::bigint bytes from l group by 1""")
def quarantine_stream(spark, d):
    """JSON lines, some empty, cut off or no object: how many rows and raw bytes went which way."""
    i = F.col("event_id")
    line = F.when(i % 13 == 0, "").when(i % 11 == 0, F.substring("props", 1, 5)).when(i % 7 == 0, F.concat(F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col("props"))
    root = state.shared_folder(spark)
    q = stores.Quarantine(spark, f"{root}/lines")
    lines = records.parsed(_stream(spark, d, "events").select(line.alias("line")), "line").drop("doc")
    _ended(q.keep(lines, F.col("why"), F.col("line"), f"{root}/checkpoint", once=True))
    sides = q.good().select(F.lit("good").alias("reason"), F.octet_length("line").alias("b")).union(q.bad().select("_reason", F.octet_length("_raw")))
    return sides.groupBy("reason").agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes"))


@query("""with e as (select user_id, epoch_us(ts) // 1000 ms, lag(epoch_us(ts) // 1000) over w before, lead(epoch_us(ts) // 1000) over w after from events window w as (partition by user_id order by epoch_us(ts) // 1000, event_id)),
  ended as (select max(epoch_us(ts) // 1000) - 10000 ms from events), s as (select user_id, ms, case when before is null then 'first' when ms - before > 43200000 then 'back' end status from e
  union all select user_id, ms + 43200000, 'stale' from e where after - ms > 43200000 or (after is null and ms + 43200000 <= (select ms from ended)))
  select user_id, status, make_timestamp(ms * 1000) as "at" from s where status is not null""")
def staleness_stream(spark, d):
    """When each user is first heard of, has been silent for twelve hours, and is heard of again: a timer for each in state."""
    root = state.shared_folder(spark)
    events = _stream(spark, d, "events").select("user_id", "event_id", "ts")
    changes = state.staleness(events, ["user_id"], "event_id", 43_200, "ts")
    _ended(changes.writeStream.outputMode("append").format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    found = spark.read.schema(changes.schema).parquet(f"{root}/changes")
    return found.select("user_id", "status", F.timestamp_millis("at_ms").cast("timestamp_ntz").alias("at"))
