"""Feeds of messages: files of framed bytes, streams of them, and synthetic ones; settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dims
from ..operators import scan
from ..operators.messages import END, START
from ..streaming.state import each_batch


#: Bytes of a file whose frames are numbered together.
STEP = 128 << 20


def frame_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """What stands between end blocks in the files a gateway has landed: ``path``, ``size``, ``block`` and ``value``.

    The end block is the reader's line separator, so a file is read in splits, however large it is, and a
    frame that crosses a split is read by the one in which it begins. Works on streams.
    """
    reader = spark.readStream if stream else spark.read
    return reader.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")


def completed(records: DataFrame) -> DataFrame:
    """``path``, ``place`` (from 0) and ``message`` of every frame of a batch of ``frame_records``.

    A frame begins at the first start block after an end block. What follows a file's last end block is no
    frame: the file's records are one byte longer than the file then, as if they had all ended. Bytes that
    are no UTF-8 are dropped from a message.
    """
    rows = records.withColumns({"_id": F.monotonically_increasing_id(), "_bytes": F.octet_length("value") + 1})
    files = rows.groupBy("path").agg((F.sum("_bytes") > F.max("size")).alias("_open"), F.max(F.struct("block", "_id")).alias("_end"))
    last = files.where("_open").select("path", F.col("_end.block").alias("block"), F.col("_end._id").alias("_id"))
    at = F.instr("value", START)
    text = F.replace(F.make_valid_utf8(F.expr(f"substring(value, instr(value, '{START}') + 1)")), F.lit("\ufffd"), F.lit(""))
    frames = rows.where(at > 0).join(last, ["path", "block", "_id"], "left_anti").select("path", "block", "_id", text.alias("message"))
    numbered = scan.scan(frames, ["path"], ["block", "_id"], STEP, _nth=scan.total(F.lit(1)))
    return numbered.select("path", (F.col("_nth") - 1).cast("long").alias("place"), "message")


def framed_files(spark: SparkSession, path: str) -> DataFrame:
    """Every frame in the files of a folder, see ``completed``."""
    return completed(frame_records(spark, path))


def framed_stream(spark: SparkSession, path: str, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand the frames of each batch of newly landed files to ``run``."""
    return each_batch(frame_records(spark, path, stream=True), lambda df, k: run(completed(df), k), checkpoint, once=once)


def message_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One message a file."""
    reader = spark.readStream.schema("value string") if stream else spark.read
    return reader.option("wholetext", True).text(path).withColumnRenamed("value", "message")


def uniform_feed(spark: SparkSession, ticks: int, seed: int = 0) -> DataFrame:
    """Readings of all beds and vitals at each tick, uniform in the reference range, a function of the seed."""
    cells = dims.bed_dim(spark).select("bed").crossJoin(dims.vital_dim(spark))  # 6 x 20 fixed rows
    u = F.pmod(F.xxhash64("tick", "bed", "vital", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    x = F.col("ref_lo") + u * (F.col("ref_hi") - F.col("ref_lo"))
    return spark.range(ticks).withColumnRenamed("id", "tick").crossJoin(F.broadcast(cells)).select("tick", "bed", "vital", F.when(F.col("kind") == "int", F.bround(x, 0)).otherwise(F.bround(x, 1)).alias("value"))


def walk_feed(spark: SparkSession, ticks: int, seed: int = 0) -> DataFrame:
    """A clamped random walk of each bed and vital. A clamp is no sum, so each walk is one fold; walks run side by side."""
    rows = [(v, float(a), float(b), float(s)) for v, (a, b, s) in dims.WALKS.items()]
    walks = dims.bed_dim(spark).select("bed").crossJoin(spark.createDataFrame(rows, "vital string, lo double, hi double, step double"))  # 6 x 20 fixed rows
    u = lambda t: F.pmod(F.xxhash64(t, F.col("bed"), F.col("vital"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    move = lambda acc, t: F.concat(acc, F.array(F.greatest(F.col("lo"), F.least(F.col("hi"), F.round(F.try_element_at(acc, F.lit(-1)) + (2 * u(t) - 1) * F.col("step"), 1)))))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(ticks - 1)) if ticks > 1 else F.array().cast("array<int>"), F.array(F.round((F.col("lo") + F.col("hi")) / 2, 1)), move)
    return walks.select("bed", "vital", F.posexplode(path).alias("tick", "value"))


def settings(path: str | Path, defaults: dict, merge: str = "deep") -> dict:
    """Settings of a file over defaults, by one of three rules: "deep" merges one level down, "shallow" lets the file's sections replace whole ones, "overlay" lays a section of numbers over the default's. A missing file gives the defaults."""
    try:
        own = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        own = {}
    if not isinstance(own, dict):
        own = {}
    if merge == "shallow":
        return {**defaults, **own}
    out = dict(defaults)
    for k, v in own.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    if merge == "overlay":
        out = {k: ({n: float(x) for n, x in v.items() if isinstance(x, (int, float))} if isinstance(v, dict) else v) for k, v in out.items()}
    return out
