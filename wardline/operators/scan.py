"""Ordered scans: running values along each key's order, of which no key is one task's work.

A key's rows are cut into parts by their order. Each part is reduced to an associative summary; a prefix over
the summaries (a row a part) says what a part begins with; then each part is replayed from that, all parts
side by side. Rows are shuffled once, by key and part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a key that stand in one part at most, where widths are chosen here.
ROWS = 100_000
#: Widths tried: from the finest, so many doublings.
DOUBLINGS = 24


@dataclass(frozen=True)
class Op:
    """A running value. ``upto``: of the rows up to and with each row, else of those before it."""

    kind: str
    value: Column
    upto: bool = True


def total(value: Column, upto: bool = True) -> Op:
    """Sum; 0 where there is nothing yet."""
    return Op("total", value, upto)


def most(value: Column, upto: bool = True) -> Op:
    """Greatest value that is not null."""
    return Op("most", value, upto)


def least(value: Column, upto: bool = True) -> Op:
    """Least value that is not null."""
    return Op("least", value, upto)


def latest(value: Column, upto: bool = True) -> Op:
    """Last value that is not null."""
    return Op("latest", value, upto)


def part_of(order: str, width: int | float) -> Column:
    """Number of the part that a row stands in; rows without an order come first."""
    return F.coalesce(F.floor(F.col(order) / F.lit(width)).cast("long"), F.lit(-(1 << 62)))


def width(df: DataFrame, keys: Sequence[str], order: str, rows: int = ROWS) -> int:
    """The widest step of a whole-number order, a power of two, at which no part of any key has more than so many rows (1, if none does).

    One job: rows are counted by key and finest step, the counts added up over doubled steps, and a number a
    step reaches the driver.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if not n:
        return 1
    finest = max(0, (int((high - low + 1) / max(1, n // max(1, rows // 64))) or 1).bit_length() - 1)  # about 1/64 of a part, were rows spread evenly
    shift = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k)).cast("long")
    counts = df.where(F.col(order).isNotNull()).groupBy(F.struct(*[F.col(k) for k in keys]).alias("_g") if keys else F.lit(0).alias("_g"), shift(F.col(order), F.lit(finest)).alias("_b")).agg(F.count("*").alias("_n"))
    steps = counts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(DOUBLINGS))))
    sums = steps.groupBy("_g", "_k", shift(F.col("_b"), F.col("_k")).alias("_p")).agg(F.sum("_n").alias("_n"))
    largest = {r["_k"]: r["_m"] for r in sums.groupBy("_k").agg(F.max("_n").alias("_m")).collect()}  # DOUBLINGS + 1 rows
    fit = [k for k in range(DOUBLINGS + 1) if largest[k] <= rows]
    return 1 << min(62, finest + max(fit)) if fit else 1


def _row_window(part: WindowSpec, upto: bool) -> WindowSpec:
    return part.rowsBetween(Window.unboundedPreceding, 0 if upto else -1)


def _running(op: Op, value: Column, w: WindowSpec) -> Column:
    if op.kind == "total":
        return F.sum(value).over(w)
    if op.kind == "latest":
        return F.last(value, ignorenulls=True).over(w)
    return (F.max if op.kind == "most" else F.min)(value).over(w)


def _summary(op: Op, value: Column, order: Column) -> Column:
    if op.kind == "total":
        return F.sum(value)
    if op.kind == "latest":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return (F.max if op.kind == "most" else F.min)(value)


def _joined(op: Op, before: Column, here: Column) -> Column:
    if op.kind == "total":
        return F.coalesce(before + here, here, before, F.lit(0))
    if op.kind == "latest":
        return F.coalesce(here, before)
    return (F.greatest if op.kind == "most" else F.least)(before, here)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int | float, **ops: Op) -> DataFrame:
    """``df`` with a column for each of ``ops``.

    ``order`` is ascending, nulls first; its first column is a number, and parts are ``step`` of it wide
    (see ``width``). Rows equal in the whole order stand in any order among themselves. Null keys are
    keys. An empty table gives no rows.
    """
    names = list(ops)
    rest = list(order)
    group = F.struct(*[F.col(k) for k in keys], part_of(rest[0], step).alias("_part"))
    own = df.select(*df.columns, group.alias("_g"), *[ops[n].value.alias(f"_v_{n}") for n in names])
    at = F.struct(*[F.col(c) for c in rest])
    sums = own.groupBy("_g").agg(*[_summary(ops[n], F.col(f"_v_{n}"), at).alias(f"_s_{n}") for n in names])
    key = F.struct(*[F.col(f"_g.{k}") for k in keys]) if keys else F.lit(0)
    parts = Window.partitionBy(key).orderBy(F.col("_g._part")).rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(F.col("_g"), *[_running(ops[n], F.col(f"_s_{n}"), parts).alias(f"_b_{n}") for n in names])
    rows = Window.partitionBy("_g").orderBy(*rest)
    replayed = own.select(*df.columns, "_g", *[_running(ops[n], F.col(f"_v_{n}"), _row_window(rows, ops[n].upto)).alias(f"_h_{n}") for n in names])
    both = replayed.join(begins, "_g", "left")
    return both.select(*df.columns, *[_joined(ops[n], F.col(f"_b_{n}"), F.col(f"_h_{n}")).alias(n) for n in names])
