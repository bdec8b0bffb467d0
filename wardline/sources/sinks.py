"""Where results go."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.messages import END, START


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A line per row, nulls written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def framed(df: DataFrame, message: str, path: str, mode: str = "append") -> None:
    """Messages between start and end blocks, as a gateway lands them."""
    df.select(F.concat(F.lit(START), F.col(message))).write.mode(mode).option("lineSep", f"{END}\r").text(path)


def append_lines(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A line per row of a stream, nulls written, each batch's files counted once."""
    writer = stream.writeStream.outputMode("append").format("json").option("ignoreNullFields", False).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def csv(df: DataFrame, path: str, *order: str) -> None:
    """With a header, empty for null, in order of the given columns (range-partitioned, so no task holds all)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def by_day(df: DataFrame, ts: str, path: str, mode: str = "append") -> None:
    """A folder per day."""
    df.withColumn("day", F.date_format(ts, "yyyyMMdd")).write.mode(mode).partitionBy("day").parquet(path)


def latest_document(latest: DataFrame) -> DataFrame:
    """The latest state (bed, vital, value, unit, time) as one JSON document; it is as large as the beds in care, not as the history."""
    leaf = F.struct("value", "unit", "time")
    beds = latest.groupBy("bed").agg(F.map_from_entries(F.collect_list(F.struct("vital", leaf))).alias("vitals"))
    return beds.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("bed", "vitals")))).alias("document"))


def replace_file(text: str, path: str | Path) -> None:
    """Write a small document whole or not at all: beside it first, then in its place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)
