"""Packing as a cutting-stock problem, solved by column generation on the histogram of lengths.

A column is a pattern: how many pieces of each length go into one sequence. A linear program chooses how
often each pattern is used so that every piece is in one; only patterns that a knapsack program prices
as worth it (by the duals of the lengths) are ever made. What is left over after rounding is packed best
fit. The driver sees at most ``capacity`` counts, whatever the number of documents; pieces find their
place by their rank among those of their length.

A sequence whose length is a power of two is not padded, so its cost is its length; any other costs the
whole capacity. Where the pieces as they are cannot fill sequences (most of one length, say), some of
them are cut in two: the patterns' gaps say where and how many, and a hash of the row which. The program
is then solved anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import packing, scratch
from .tokenizing import byte_tokenizer, slices

SEQUENCE = 1024
#: What a sequence costs besides its tokens, in tokens of padding.
SEQUENCE_COST = 4.0
#: Columns are made until the cost is within this share of what no packing can be under, none is worth making, or so many steps have gained less than that share of the tokens. Whatever is reached is a packing.
CLOSE, SLOW, SLOW_GAIN = 2e-4, 60, 5e-5
#: Columns taken from one knapsack at most.
AT_ONCE = 8
#: Linear programs at most, each over what rounding the one before left.
ROUNDS = 3
#: Pieces are cut only where this share of the tokens would be padding otherwise, to fill gaps of so many tokens at least, in so many rounds at most.
CUT_ABOVE, CUT_GAP, CUT_ROUNDS = 0.005, 8, 4
#: Pieces of one length and salt that a task ranks, about.
RANKED = 20_000
#: Runs of a plan that are broadcast at most.
PLAN_ROWS = 200_000

Pattern = dict[int, int]
Run = tuple[int, int, int, int, int, int]


def padded(total: int, capacity: int) -> int:
    """Length of a sequence with its padding."""
    return total if total & (total - 1) == 0 else capacity


class Columns:
    """Revised simplex over the lengths as rows (each an equation) with columns made as they are needed."""

    def __init__(self, counts: dict[int, float], capacity: int):
        self.capacity = capacity
        self.lengths = np.array(sorted(counts), np.int64)
        self.row = {int(n): i for i, n in enumerate(self.lengths)}
        self.demand = np.array([counts[int(n)] for n in self.lengths], float)
        m = len(self.lengths)
        self.basis: list[Pattern] = []
        self.cost_of = np.array([np.inf] + [padded(t, capacity) + SEQUENCE_COST for t in range(1, capacity + 1)])
        self._begin()
        self.costs = np.array([self.price(p) for p in self.basis])
        self.inverse = np.linalg.inv(self._matrix()) if m else np.zeros((0, 0))
        self.x = self.inverse @ self.demand

    def _begin(self) -> None:
        """A first basis: the longest that is left and what fits beside it, longest first, used until one length is out. No later pattern has that length, so the matrix is triangular."""
        left = self.demand.copy()
        open_ = np.ones(len(left), bool)
        while open_.any():
            room, pattern = self.capacity, {}
            for i in np.flatnonzero(open_)[::-1].tolist():
                n = int(self.lengths[i])
                if (k := min(room // n, max(1, int(left[i])))) > 0:
                    pattern[i] = k
                    room -= k * n
                if room < self.lengths[0]:
                    break
            at = np.array(list(pattern))
            ratio = left[at] / np.array(list(pattern.values()))
            times = ratio.min()
            left[at] = np.maximum(0, left[at] - times * np.array(list(pattern.values())))
            open_[at[int(ratio.argmin())]] = False
            self.basis.append({int(self.lengths[i]): k for i, k in pattern.items()})

    def _patterns(self, worth: np.ndarray) -> list[tuple[float, Pattern]]:
        """Knapsack over exact totals; of the totals, those whose best pattern is worth most over its cost."""
        best = np.full(self.capacity + 1, -np.inf)
        best[0], last = 0.0, np.zeros(self.capacity + 1, np.int64)
        upto = np.searchsorted(self.lengths, np.arange(self.capacity + 1), side="right")
        for c in range(int(self.lengths[0]), self.capacity + 1):
            k = upto[c]
            v = best[c - self.lengths[:k]] + worth[:k]
            i = int(v.argmax())
            best[c], last[c] = v[i], i
        gain = best - self.cost_of
        out = []
        for c in (c for c in np.argsort(-gain)[:AT_ONCE].tolist() if gain[c] > -np.inf):
            pattern: Pattern = {}
            at = c
            while at:
                n = int(self.lengths[last[at]])
                pattern[n] = pattern.get(n, 0) + 1
                at -= n
            out.append((float(gain[c]), pattern))
        return out

    def _column(self, pattern: Pattern) -> np.ndarray:
        a = np.zeros(len(self.lengths))
        for n, k in pattern.items():
            a[self.row[n]] = k
        return a

    def _enter(self, pattern: Pattern, a: np.ndarray) -> None:
        d = self.inverse @ a
        open_ = d > 1e-9
        ratio = np.full(len(d), np.inf)
        ratio[open_] = np.maximum(self.x[open_], 0) / d[open_]
        least = ratio.min()
        near = np.flatnonzero(ratio <= least + 1e-12)
        r = int(near[d[near].argmax()])  # of equals, the safest pivot
        self.x -= least * d
        self.x[r] = least
        self.inverse[r] /= d[r]
        d[r] = 0
        hit = np.flatnonzero(d)
        self.inverse[hit] -= d[hit, None] * self.inverse[r]
        self.basis[r], self.costs[r] = pattern, self.price(pattern)

    def price(self, pattern: Pattern) -> float:
        return float(self.cost_of[sum(n * k for n, k in pattern.items())])

    def solve(self) -> None:
        tokens = float(self.lengths @ self.demand)
        least = tokens * (1 + SEQUENCE_COST / self.capacity)
        steps, marked = 0, (0, np.inf)
        while (cost := float(self.costs @ self.x)) > least * (1 + CLOSE):
            if steps >= marked[0] + SLOW:
                if cost > marked[1] - SLOW_GAIN * tokens:
                    return
                marked = (steps, cost)
            made = self._patterns(self.costs @ self.inverse)
            if made[0][0] <= 1e-6 * self.capacity:
                return
            for _, pattern in made:
                a = self._column(pattern)
                if (self.costs @ self.inverse) @ a - self.price(pattern) < 0.5 * made[0][0]:  # those entered before it have used up what it was worth
                    continue
                self._enter(pattern, a)
                steps += 1
                if steps % 400 == 0:  # rounding errors do not add up
                    self.inverse = np.linalg.inv(self._matrix())
                    self.x = self.inverse @ self.demand

    def _matrix(self) -> np.ndarray:
        return np.stack([self._column(p) for p in self.basis], axis=1)


def patterns(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns and how often each is used, whole numbers, and the pieces by length that none of them takes."""
    out: list[tuple[Pattern, int]] = []
    left = {n: k for n, k in counts.items() if k > 0 and n < capacity}
    for _ in range(ROUNDS if left else 0):
        program = Columns(left, capacity)
        program.solve()
        rest, used = dict(left), []
        order = np.argsort(-program.x)
        for j in order.tolist():
            if (k := int(program.x[j] + 1e-6)) > 0:
                used.append((program.basis[j], k))
                for n, a in program.basis[j].items():
                    rest[n] -= a * k
        if any(k < 0 for k in rest.values()):  # a step that rounding errors spoilt: nothing of it is used
            break
        for j in np.argsort(-(program.x % 1)).tolist():  # then once more, the nearest to whole first, where the pieces are there
            if program.x[j] > 1e-6 and all(rest[n] >= a for n, a in program.basis[j].items()):
                used.append((program.basis[j], 1))
                for n, a in program.basis[j].items():
                    rest[n] -= a
        out += used
        before, left = sum(left.values()), {n: k for n, k in rest.items() if k}
        if sum(left.values()) > 0.7 * before or len(left) < 8:  # little is gained by another round
            break
    return out, left


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[Run]:
    """Runs as ``packing.plan`` gives them: (length, first rank, end rank, pieces a sequence, first sequence, offset)."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"a piece does not fit into {capacity}")
    runs: list[Run] = []
    rank = dict.fromkeys(counts, 0)
    sequence = 0
    chosen, left = patterns(counts, capacity)
    if counts.get(capacity):
        chosen.append(({capacity: 1}, counts[capacity]))
    for pattern, times in chosen:
        at = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            runs.append((n, rank[n], rank[n] + k * times, k, sequence, at))
            rank[n] += k * times
            at += k * n
        sequence += times
    for n, a, b, fit, first, at in packing.plan(left, capacity):
        runs.append((n, rank[n] + a, rank[n] + b, fit, sequence + first, at))
    return runs


def padding(runs: list[Run], capacity: int = SEQUENCE) -> tuple[int, int]:
    """Tokens of padding of a plan, and tokens in it. Sequences of a run are alike, so cost is added up between the runs' ends."""
    steps: dict[int, int] = {}
    for n, a, b, fit, first, _ in runs:
        whole, part = divmod(b - a, fit)
        for s, e, k in ((first, first + whole, fit), (first + whole, first + whole + 1, part)):
            if k and e > s:
                steps[s] = steps.get(s, 0) + n * k
                steps[e] = steps.get(e, 0) - n * k
    total = cost = filled = 0
    at = sorted(steps)
    for s, e in zip(at, at[1:], strict=False):
        filled += steps[s]
        total += filled * (e - s)
        cost += padded(filled, capacity) * (e - s) if filled else 0
    return cost - total, total


def cut_shares(counts: dict[int, int], capacity: int = SEQUENCE) -> dict[int, list[tuple[float, int]]]:
    """By length, in order: up to which share of its pieces are cut, and after how many ids.

    Of the sequences of a pattern with a gap, so many give up their longest pieces that one part of each,
    as long as the gap, fills it in the others.
    """
    wanted: dict[int, dict[int, float]] = {}
    chosen, left = patterns(counts, capacity)
    chosen += [({n: max(1, min(k, capacity // n))}, -(-k // max(1, min(k, capacity // n)))) for n, k in left.items()]
    for pattern, times in chosen:
        total, longest = sum(n * k for n, k in pattern.items()), max(pattern)
        gap = padded(total, capacity) - total
        if CUT_GAP <= gap < longest:
            cuts = times * pattern[longest] / (1 + pattern[longest])
            own = wanted.setdefault(longest, {})
            own[gap] = own.get(gap, 0.0) + cuts
    shares: dict[int, list[tuple[float, int]]] = {}
    for n, own in wanted.items():
        upto = 0.0
        for gap, cuts in sorted(own.items()):
            upto += cuts / counts[n]
            shares.setdefault(n, []).append((upto, gap))
    return shares


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, then ``end_id``, in pieces of ``capacity`` and a rest: id, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian uint32).

    Null and empty texts give one piece that holds ``end_id`` alone; an empty table gives none. Repeated
    and null ids are pieces like any others. Other columns are not read.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)] + [StructField(c, LongType()) for c in ("start", "length", "doc_tokens")] + [StructField("ids", BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                at, start, whole, ids = [], [], [], []
                for row, x in enumerate(tokenizer.encode([t or "" for t in part.column(1).to_pylist()])):
                    x += end
                    n = len(x) // 4
                    for a in range(0, n, capacity):
                        at.append(row)
                        start.append(a)
                        whole.append(n)
                        ids.append(x[4 * a : 4 * (a + capacity)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, [len(x) // 4 for x in ids], whole)), pa.array(ids, pa.binary())], names=schema.names
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cut(pieces: DataFrame, shares: dict[int, list[tuple[float, int]]], id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with the given shares of each length cut in two; a piece is chosen by a hash of its id and place."""
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, start, ids = [], [], []
                columns = [part.column(k).to_pylist() for k in (1, 2, 4, 5)]
                for row, (s, n, x, u) in enumerate(zip(*columns, strict=True)):
                    k = next((k for upto, k in shares.get(n, ()) if u < upto), 0)
                    for a, b in ((0, k), (k, n)) if k else ((0, n),):
                        at.append(row)
                        start.append(s + a)
                        ids.append(x[4 * a : 4 * b])
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), part.column(3).take(rows), pa.array(ids, pa.binary())], names=schema.names
                )

    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col("start"), F.lit("cut")), 11) / float(1 << 53)
    return pieces.select(*schema.names, chance.alias("_u")).mapInArrow(run, schema)


def lengths_of(pieces: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most ``capacity`` rows


def place(pieces: DataFrame, counts: dict[int, int], runs: list[Run], order_by: tuple[str, ...]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` after a plan of runs.

    Pieces of a length are ranked within salts of about RANKED pieces, as many salts as the length's own
    count asks for, and a salt begins at the number of pieces in those before it. ``pieces`` is read
    twice and must give the same rows each time (a written table).
    """
    spark = pieces.sparkSession
    names = pieces.columns
    salts = spark.createDataFrame([(n, max(1, -(-k // RANKED))) for n, k in counts.items()], "_l long, _salts int")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_l")).select(*names, F.pmod(F.xxhash64(*order_by), F.col("_salts")).cast("int").alias("_salt"))  # at most ``capacity`` rows
    before = salted.groupBy(F.col("length").alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    before = before.select("_l", "_s", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order_by)) - 1
    ranked = salted.withColumn("_nth", nth).join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_nth") + F.col("_before"))
    table = spark.createDataFrame(runs, "_length long, _from long, _to long, _fit long, _first long, _at long")
    if len(runs) <= PLAN_ROWS:
        table = F.broadcast(table)
    placed = ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    k = F.col("_rank") - F.col("_from")
    return placed.select(
        *names, (F.col("_first") + F.floor(k / F.col("_fit"))).cast("long").alias("sequence_id"), (F.col("_at") + (k % F.col("_fit")) * F.col("length")).cast("long").alias("offset")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Documents to pieces in sequences: id, ``start``, ``length``, ``doc_tokens``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids`` unless ``keep_ids`` is false.

    A document is cut where it is longer than ``capacity``, and else only to fill gaps that the linear
    program leaves (see the head of this module). Sequences have no gaps and hold at most ``capacity`` tokens. Rows that
    are equal in all columns are cut alike. See ``token_pieces`` for null, empty and repeated rows; an
    empty table gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    pieces = scratch.write(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = lengths_of(pieces)
    runs = plan(counts, capacity) if counts else []
    for _ in range(CUT_ROUNDS):
        lost, tokens = padding(runs, capacity)
        if lost <= CUT_ABOVE * tokens or not (shares := cut_shares(counts, capacity)):
            break
        other = scratch.write(cut(pieces, shares, id_col), "pieces")
        again = lengths_of(other)
        other_runs = plan(again, capacity)
        better = padding(other_runs, capacity)[0] < 0.9 * lost
        if better:
            pieces, other, counts, runs = other, pieces, again, other_runs
        scratch.release(spark, scratch.tables_of(other))
        if not better:
            break
    out = pieces.withColumn("ids_crc32", F.crc32("ids"))
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    if not counts:
        return out.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where(F.lit(False))
    return place(out.select(*columns), counts, runs, (id_col, "start", "ids_crc32", "doc_tokens"))
