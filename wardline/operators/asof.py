"""Joins on time: windows of the past, latest before, nearest. No plan here is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


def micros(ts: str) -> Column:
    """Whole microseconds of a zoned or zoneless time, by which bins and order agree."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def range_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lookback_s: float, keys: list[str] = (), most: int | None = None, order: list[Column] = (), how: str = "inner") -> DataFrame:
    """Pairs with ``left_time - lookback <= right_time <= left_time`` and equal ``keys``.

    An equi-join on bins as wide as the lookback: a left row looks into two bins, a right row stands in
    one. ``most`` keeps the newest so many of each left row (ties by ``order``) and makes no other pairs, which needs ``left`` to carry ``_left``, a unique id.
    Columns but the keys must differ in name.
    """
    width = int(lookback_s * 1_000_000)
    keys = list(keys)
    if most is not None:
        joined = windows.newest_pairs(left, right, micros(left_time), micros(right_time), width, keys, most, order)
    else:
        bin_of = lambda c: F.floor(micros(c) / F.lit(max(width, 1)))
        a = left.withColumn("_bin", F.explode(F.array(bin_of(left_time), bin_of(left_time) - 1)))
        b = right.withColumn("_bin", bin_of(right_time))
        near = (micros(left_time) - micros(right_time)).between(0, width)
        joined = a.join(b, ["_bin", *keys], "inner").where(near).drop("_bin")
    return joined if how == "inner" else left.join(joined.select("_left", *[c for c in joined.columns if c not in left.columns]), "_left", "left")


def closest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lookback_s: float, keys: list[str], left_value: str, right_value: str, order: list[Column] = ()) -> DataFrame:
    """Of each left row (``_left``: a unique id) the pair of least ``abs(left_value - right_value)`` in the window of ``range_join`` (no error counts as infinite, not-a-number is greater), then the newest, then by ``order``. Other pairs are not made."""
    return windows.closest_pairs(left, right, micros(left_time), micros(right_time), int(lookback_s * 1_000_000), list(keys), (left_value, right_value), order)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str] = (), bucket_s: int = 86_400, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row at or before its time (``forward``: the earliest at or after; ``strict``: not at it).

    Both sides stand in one order within a bucket of time (and ``keys``), so that no key, nor its lack,
    makes one partition of everything. What a bucket ends with is carried into the ones after it by a
    table of one row per bucket.
    """
    keys, sign = list(keys), -1 if forward else 1
    rest = [c for c in right.columns if c not in keys]
    bucket = lambda c: F.floor(micros(c) / F.lit(bucket_s * 1_000_000)).cast("long")
    at = lambda c: sign * micros(c)
    payload = F.struct(*[F.col(c) for c in rest])
    r = right.where(F.col(right_time).isNotNull()).select(*keys, (sign * bucket(right_time)).alias("_b"), at(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_s"), payload.alias("_r"), F.lit(None).alias("_l"))
    whole = F.struct(*[F.col(c) for c in left.columns])
    row = left.select(*keys, (sign * bucket(left_time)).alias("_b"), at(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_s"), F.lit(None).alias("_r"), whole.alias("_l"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, -1)
    merged = r.unionByName(row).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    # One row per key and bucket: the last right row in it, then of the buckets before.
    ends = r.groupBy(*keys, "_b").agg(F.max_by("_r", "_t").alias("_e"))
    needed = row.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full_outer" if keys else "full_outer")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = needed.withColumn("_c", F.last("_e", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_cb"), "_c")
    on = [F.col("_b").eqNullSafe(F.col("_cb"))] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    hit = merged.join(carried, cond, "left").withColumn("_hit", F.coalesce("_hit", "_c"))
    return hit.select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in rest])


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, window_s: float, keys: list[str] = (), bucket_s: int = 86_400) -> DataFrame:
    """``left`` with the ``right`` row nearest in time (the past one if as near); if it is further than the window and there is a past one, the latest past one.

    Adds ``delta_s`` (right minus left). Left rows keep their columns.
    """
    rest = [c for c in right.columns if c not in keys]
    past = asof(left, right.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in rest]), left_time, f"_p_{right_time}", keys, bucket_s)
    both = asof(past, right.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest]), left_time, f"_n_{right_time}", keys, bucket_s, forward=True)
    back = micros(left_time) - micros(f"_p_{right_time}")
    ahead = micros(f"_n_{right_time}") - micros(left_time)
    ahead_nearer = F.coalesce(ahead < back, back.isNull())
    use_next = ahead_nearer & (back.isNull() | (ahead <= F.lit(int(window_s * 1_000_000))))
    chosen = [F.when(use_next, F.col(f"_n_{c}")).otherwise(F.col(f"_p_{c}")).alias(c) for c in rest]
    delta = F.when(use_next, ahead).otherwise(-back) / F.lit(1e6)
    return both.select(*left.columns, *chosen, delta.alias("delta_s"))
