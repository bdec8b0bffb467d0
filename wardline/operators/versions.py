"""Successive snapshots as intervals of validity: a value is kept once for as long as it stands, and read as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asof, scan


def intervals(rows: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], step: int | None = None) -> DataFrame:
    """``keys``, ``values``, ``valid_from`` and ``valid_to`` (the first snapshot at which it no longer stands; null where it stands in the last).

    ``rows`` has a row for each key that a snapshot holds; a snapshot is a ``time``. A key that a snapshot lacks
    ends there, though it may come back. A key twice in a snapshot counts by its greatest values. Null values
    are values, null keys keys; rows without a time do not count. An empty table gives no rows.
    """
    own = rows.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v"))
    times = own.select(F.col(time).alias("_ts")).distinct().withColumn("_us", asof.micros("_ts"))
    nth = scan.scan(times, [], ["_us"], step or scan.width(times, [], "_us"), _n=scan.total(F.lit(1)))
    held = own.join(nth.select(F.col("_ts").alias(time), "_n"), time)
    part = scan.ROWS
    seen = scan.scan(held, keys, ["_n"], part, _b=scan.latest(F.struct(F.col("_n").alias("n"), F.col("_v").alias("v")), upto=False))
    goes_on = F.coalesce((F.col("_b.n") == F.col("_n") - 1) & F.col("_b.v").eqNullSafe(F.col("_v")), F.lit(False))
    runs = scan.scan(seen.withColumn("_start", F.when(~goes_on, F.col("_n"))), keys, ["_n"], part, _run=scan.latest(F.col("_start")))
    spans = runs.groupBy(*keys, "_run").agg(F.first("_v").alias("_v"), F.min(time).alias("valid_from"), (F.max("_n") + 1).alias("_end"))
    out = spans.join(nth.select(F.col("_n").alias("_end"), F.col("_ts").alias("valid_to")), "_end", "left")
    return out.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values], "valid_from", "valid_to")


def changes(rows: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Like ``intervals``, where each key has snapshots of its own: its values stand until its next row, whenever that is."""
    own = rows.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_us", asof.micros(time))
    step = scan.width(own, list(keys), "_us")
    seen = scan.scan(own, list(keys), ["_us"], step, _b=scan.latest(F.struct(F.col("_v").alias("v")), upto=False))
    new = seen.where(F.col("_b").isNull() | ~F.col("_b.v").eqNullSafe(F.col("_v"))).drop("_b")
    # What ends a row is the next that begins: the last one seen, going backwards.
    ends = scan.scan(new.withColumn("_back", -F.col("_us")), list(keys), ["_back"], step, _e=scan.latest(F.col(time), upto=False))
    return ends.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values], F.col(time).alias("valid_from"), F.col("_e").alias("valid_to"))


def as_of(left: DataFrame, versions: DataFrame, keys: Sequence[str], time: str, bucket_s: int = 86_400) -> DataFrame:
    """``left`` with what stood for its keys at its time (null where nothing did)."""
    rest = [c for c in versions.columns if c not in keys]
    hit = asof.asof(left, versions, time, "valid_from", list(keys), bucket_s)
    stands = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(time)))
    return hit.select(*left.columns, *[F.when(stands, F.col(c)).alias(c) for c in rest])
