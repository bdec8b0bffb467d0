"""State over streams: latest values, counters, values held, staleness; windows with late data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import latest as _latest


def rocksdb(spark) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shared_folder(spark) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``); where that is unset a local session gets one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/streams/{uuid.uuid4().hex}"


def latest(stream: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Latest row of each key in order of arrival; for complete or update mode."""
    return _latest.latest(stream, keys, sequence)


class _Hold(StatefulProcessor):
    """The last value of a key that was there. A batch may come in several pieces: they are put in order first."""

    def __init__(self, order: str, value: str):
        self.order, self.value = order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(self.order)
        prior = self.last.get()[0] if self.last.exists() else None
        seen = own[self.value].astype("float64")
        filled = pd.concat([pd.Series([prior], dtype="float64"), seen]).ffill()
        before = filled.iloc[:-1].to_numpy()
        own["held"] = seen.where(seen.notna(), before)
        own["imputed"] = seen.isna().to_numpy() & ~pd.isna(before)
        if pd.notna(filled.iloc[-1]):
            self.last.update((float(filled.iloc[-1]),))
        yield own

    def close(self) -> None:
        pass


def hold_last(stream: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """As the batch operator: ``held`` and ``imputed``, with the prior value of each key kept between batches."""
    rocksdb(stream.sparkSession)
    columns = stream.select(*stream.columns, F.lit(None).cast("double").alias("held"), F.lit(None).cast("boolean").alias("imputed")).schema
    return stream.groupBy(*keys).transformWithStateInPandas(_Hold(order, value), outputStructType=columns, outputMode="Append", timeMode="None")


class _Stale(StatefulProcessor):
    """When a key was last heard of with a stamp of its own, and a timer for when that is too long ago."""

    def __init__(self, after_ms: int, stamp: str, at: str | None, key: list[str]):
        self.after, self.stamp, self.at, self.key = after_ms, stamp, at, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "stamp string, at long, stale boolean")

    def _row(self, key: Any, status: str, ms: int, stamp: str) -> dict:
        return dict(zip(self.key, key, strict=True)) | {"status": status, "at_ms": ms, "stamp": stamp}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows))
        if self.at is None:
            now = int(timerValues.getCurrentProcessingTimeInMs())
            heard = [(now, s) for s in own[self.stamp]]
        else:
            heard = sorted((int(t), s) for t, s in zip(own[self.at], own[self.stamp], strict=True) if not pd.isna(t) and not pd.isna(s))
        stamp, at, stale = self.seen.get() if self.seen.exists() else (None, None, False)
        begin, out = at, []
        for ms, s in heard:
            if pd.isna(s) or s == "" or s == stamp or (at is not None and ms < at):
                continue
            if at is None:
                out.append(self._row(key, "first", ms, s))
            elif stale or ms - at > self.after:
                if not stale:  # its time ran out between two rows of one batch
                    out.append(self._row(key, "stale", at + self.after, stamp))
                out.append(self._row(key, "back", ms, s))
            stamp, at, stale = s, ms, False
        if at != begin:
            if begin is not None:
                self.handle.deleteTimer(begin + self.after)
            self.handle.registerTimer(at + self.after)
            self.seen.update((stamp, at, stale))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stamp, at, stale = self.seen.get()
        if not stale and expiredTimerInfo.getExpiryTimeInMs() == at + self.after:
            self.seen.update((stamp, at, True))
            yield pd.DataFrame([self._row(key, "stale", at + self.after, stamp)])

    def close(self) -> None:
        pass


def staleness(stream: DataFrame, keys: list[str], stamp: str, after_s: float, ts: str | None = None, late: str = "10 seconds") -> DataFrame:
    """A row when a key is first heard of, turns stale (no new ``stamp`` for ``after_s``) and comes back: keys, ``status``, ``at_ms``, ``stamp``.

    Each new stamp moves the key's timer. With ``ts`` time is that of the rows, and timers run out as the
    watermark (``late`` behind) passes them; what comes out does not depend on how rows fall into batches.
    Without, it is the time of processing. Rows without a stamp, or a time, are no news.
    """
    rocksdb(stream.sparkSession)
    wanted = [c for c in (*keys, stamp, ts) if c]
    own = stream.select(*dict.fromkeys(wanted)).withColumn(stamp, F.col(stamp).cast("string"))
    own = own if ts is None else _instants(own, ts).withColumn("heard_ms", F.unix_millis(ts)).withWatermark(ts, late)
    schema = own.select(*keys, F.lit("").alias("status"), F.lit(0).cast("long").alias("at_ms"), F.col(stamp).alias("stamp")).schema
    return own.groupBy(*keys).transformWithStateInPandas(_Stale(int(after_s * 1000), stamp, ts and "heard_ms", keys), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ts is None else "EventTime")


def _instants(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks are on instants: a zoneless time is taken in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and means of windows in event time; rows later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _instants(stream, ts).withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Messages sent again within the watermark go."""
    return _instants(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def each_batch(df: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """A query that hands every batch to ``run``: as a service, or once over what is there."""
    writer = df.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
