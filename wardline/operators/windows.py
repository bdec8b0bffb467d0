"""The few right rows that each left row wants of a window of the past, found without making all pairs.

Both sides stand in blocks of time, at least as wide as the lookback and otherwise chosen by counts, so that a
left row's whole window lies in its block; a right row stands in one block, or two. Where a window alone holds more rows
than a block should, its sides are cut into pieces that meet each other, and what the pieces found is
ranked once more. A block's work is rows times logarithms, however many rows a window holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scan
from .latest import few

#: Rows of both sides in a block, about.
ROWS = 50_000
Picks = tuple[np.ndarray, np.ndarray]


def newest(lo: np.ndarray, hi: np.ndarray, most: int) -> Picks:
    """Of each range of places the last ``most``: number of the range, place."""
    size = np.minimum(np.maximum(hi - lo, 0), most)
    i = np.repeat(np.arange(len(lo)), size)
    return i, hi[i] - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size))


def _least_finite(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of ``v`` (finite) the place of least ``abs(x - v)``, the last of equal ones (-1: empty range), and that error.

    A range is cut into blocks of doubling size, two of a size at most; in each, sorted by value, the neighbours of x are looked up.
    """
    best, error = np.full(len(x), -1), np.full(len(x), np.inf)
    values, code = np.unique(v, return_inverse=True)
    above, base = np.searchsorted(values, x, side="right"), len(values) + 1
    by, lo, hi, size = np.arange(len(v)), lo.copy(), np.maximum(lo, hi), 1

    def look(rows: np.ndarray, block: np.ndarray) -> None:
        for up in (False, True):
            own, b = rows, block
            at = np.searchsorted(key, b * base + above[own]) - (not up)
            near = None
            while True:
                inside = (at >= b * size) & (at < np.minimum((b + 1) * size, len(v)))
                own, b, at = own[inside], b[inside], at[inside]
                near = near[inside] if near is not None else None
                if up:  # the last of its equals
                    at = np.searchsorted(key, key[at], side="right") - 1
                e = np.abs(x[own] - v[by[at]])
                if near is not None:  # further off, and yet of the same error once rounded
                    same = e == near
                    own, b, at, e = own[same], b[same], at[same], e[same]
                near = e
                if not len(own):
                    break
                better = (e < error[own]) | ((e == error[own]) & (by[at] > best[own]))
                error[own[better]], best[own[better]] = e[better], by[at[better]]
                at = at + 1 if up else np.searchsorted(key, key[at]) - 1

    while len(v) and (lo < hi).any():
        key = np.arange(len(v)) // size * base + code[by]
        again = np.argsort(key, kind="stable")  # two sorted runs a block
        by, key = by[again], key[again]
        odd = np.flatnonzero((lo < hi) & (lo & 1 == 1))
        look(odd, lo[odd])
        lo[odd] += 1
        odd = np.flatnonzero((lo < hi) & (hi & 1 == 1))
        look(odd, hi[odd] - 1)
        hi[odd] -= 1
        lo, hi, size = lo >> 1, hi >> 1, size * 2
    return best, error


def closest(value: np.ndarray, value_null: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, x_null: np.ndarray) -> Picks:
    """Of each range that is not empty the place of least ``abs(x - value)``, the last of equal ones: range, place. No error, for want of a number, is as an infinite one; not-a-number is greater."""
    kind = lambda a, null: np.select([null, np.isnan(a), a == np.inf, a == -np.inf], [0, 1, 2, 3], 4)
    of, mine = kind(value, value_null), kind(x, x_null)
    finite = np.flatnonzero(of == 4)
    a, b = np.searchsorted(finite, lo), np.searchsorted(finite, hi)
    at, error = _least_finite(value[finite], a, np.where(mine == 4, b, a), np.where(mine == 4, x, 0.0))
    found = np.isfinite(error)
    # Otherwise the last row of infinite error, or else the last of no number.
    place = np.arange(len(of))
    last = [np.concatenate([[-1], np.maximum.accumulate(np.where(of == k, place, -1))])[hi] for k in range(5)]
    infinite, other = np.full(len(x), -1), np.full(len(x), -1)
    for k in range(5):
        nan = (mine != 0) & (k != 0) & ((mine == 1) | (k == 1) | ((mine == k) & (k < 4)))
        infinite = np.where(~nan, np.maximum(infinite, last[k]), infinite)
        other = np.where(nan, np.maximum(other, last[k]), other)
    rest = np.where(infinite >= lo, infinite, other)
    pick = np.where(found, finite[at] if len(finite) else -1, rest)
    i = np.flatnonzero((lo < hi) & (pick >= lo))
    return i, pick[i]


def _picked(
    left: DataFrame, right: DataFrame, left_time: Column, right_time: Column, lookback: int, keys: Sequence[str], order: Sequence[Column],
    values: tuple[str, str] | None, pick: Callable[..., Picks], rows: int,
) -> tuple[DataFrame, bool]:
    """Picked pairs, and whether windows were cut into pieces (each piece has picked then). Times are whole microseconds."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    number = lambda k: F.col(values[k]).cast("double") if values else F.lit(None).cast("double")
    a = left.withColumns({"_t": left_time, "_v": number(0), "_side": F.lit(0)}).where(known & F.col("_t").isNotNull())
    b = right.withColumns({"_t": right_time, "_v": number(1), "_side": F.lit(1)}).where(known & F.col("_t").isNotNull())
    width = scan.width(a.select(*keys, "_t").unionAll(b.select(*keys, "_t")), keys, "_t", rows)
    step = max(width, lookback, 1)
    begin = lambda t: t - F.pmod(t, F.lit(step))
    a = a.withColumn("_b", begin(F.col("_t")))
    b = b.withColumn("_b", F.explode(F.array_distinct(F.array(begin(F.col("_t")), begin(F.col("_t") + lookback)))))
    group, cut = [*keys, "_b"], width < step
    if cut:
        size = lambda side: F.ceil(F.count_if(F.col("_side") == side) / rows).cast("int")
        sizes = a.select(*group, "_side").unionAll(b.select(*group, "_side")).groupBy(*group).agg(size(0).alias("_ls"), size(1).alias("_rs"))
        many = few(sizes.where("_ls > 1 or _rs > 1"))
        count = lambda of: F.greatest(F.coalesce(of, F.lit(1)), F.lit(1))
        own = lambda df, of: F.pmod(F.xxhash64(*df.columns), count(of))
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), count(of).cast("long") - 1))
        a = a.join(many, group, "left").withColumn("_p", own(left, "_ls")).withColumn("_q", every("_rs"))
        b = b.join(many, group, "left").withColumn("_q", own(right, "_rs")).withColumn("_p", every("_ls"))
        a, b, group = a.drop("_ls", "_rs"), b.drop("_ls", "_rs"), [*group, "_p", "_q"]
    ranked = Window.partitionBy(*group).orderBy("_side", F.desc("_t"), *order)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_rank", F.row_number().over(ranked))
    mine, theirs = left.columns, [c for c in right.columns if c not in keys]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, t, rank = (np.asarray(table.column(c)) for c in ("_side", "_t", "_rank"))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        two = two[np.argsort(-rank[two].astype(np.int64))]  # what is preferred stands later
        lo, hi = np.searchsorted(t[two], t[one] - lookback), np.searchsorted(t[two], t[one], side="right")
        v, null = table.column("_v").to_numpy(), np.asarray(table.column("_v").is_null())
        i, j = pick(lo, hi) if values is None else pick(v[two], null[two], lo, hi, v[one], null[one])
        at, of = pa.array(one[i]), pa.array(two[j])
        return pa.Table.from_arrays([*(table.column(c).take(at) for c in mine), *(table.column(c).take(of) for c in theirs)], names=[*mine, *theirs])

    schema = StructType([*(left.schema[c] for c in mine), *(right.schema[c] for c in theirs)])
    return both.groupBy(*group).applyInArrow(run, schema), cut


def newest_pairs(left: DataFrame, right: DataFrame, left_time: Column, right_time: Column, lookback: int, keys: Sequence[str], most: int, order: Sequence[Column] = (), rows: int = ROWS) -> DataFrame:
    """Of each left row (``_left``: a unique id) the newest ``most`` right rows of its window, ties by ``order``."""
    found, cut = _picked(left, right, left_time, right_time, lookback, keys, order, None, lambda lo, hi: newest(lo, hi, most), rows)
    return _first(found, most, right_time.desc(), *order) if cut else found


def closest_pairs(left: DataFrame, right: DataFrame, left_time: Column, right_time: Column, lookback: int, keys: Sequence[str], values: tuple[str, str], order: Sequence[Column] = (), rows: int = ROWS) -> DataFrame:
    """Of each left row (``_left``: a unique id) the right row of its window nearest in value, then newest, then by ``order``."""
    found, cut = _picked(left, right, left_time, right_time, lookback, keys, order, values, closest, rows)
    error = F.coalesce(F.abs(F.col(values[0]).cast("double") - F.col(values[1]).cast("double")), F.lit(float("inf")))
    return _first(found, 1, error, right_time.desc(), *order) if cut else found


def _first(pairs: DataFrame, n: int, *order: Column) -> DataFrame:
    return pairs.withColumn("_nth", F.row_number().over(Window.partitionBy("_left").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
