"""Best-fit packing planned on the histogram of lengths.

The plan needs only how many pieces there are of each length: at most ``capacity`` numbers reach the
driver, whatever the number of documents. It fills sequences best-fit, longest first, for all pieces
of a length at once, and comes out as runs: "pieces of length L with rank r0 to r1 go k to a sequence,
from sequence s, at offset o". Pieces then find their slot by their rank among those of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import scratch
from .tokenizing import byte_tokenizer, slices

SEQUENCE = 2048
#: Pieces of one length and salt that a task ranks, about.
RANKED = 200_000
#: Runs of a plan that are broadcast at most; a longer plan is joined by a shuffle.
PLAN_ROWS = 200_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, then ``end_id``, in pieces: id, ``piece``, ``start``, ``length`` and ``ids`` (little-endian uint32).

    A document of more than ``capacity`` ids is cut so that every piece but the first is full. Null
    and empty texts give one piece that holds ``end_id`` alone; an empty table gives no pieces.
    Repeated and null document ids are pieces like any others. Other columns are not read.
    """
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                at, piece, start, ids = [], [], [], []
                for row, x in enumerate(tokenizer.encode([t or "" for t in part.column(1).to_pylist()])):
                    x += end
                    n = len(x) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        at.append(row)
                        piece.append(k)
                        start.append(a)
                        ids.append(x[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, end rank, pieces a sequence, first sequence, offset).

    Sequences with the same room left are held as ranges; a length takes the least room that holds
    it, as many pieces to a sequence as fit there, before it goes to more room or opens new sequences.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: first sequence, end
    opened = 0

    def keep(room: int, first: int, end: int) -> None:
        if room and end > first:
            if room not in ranges:
                insort(rooms, room)
            ranges[room].append((first, end))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, end = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room = capacity
                first, end = opened, opened + -(-left // (capacity // length))
                opened = end
            fit = room // length
            full = min(end - first, left // fit)
            if full:
                runs.append((length, rank, rank + full * fit, fit, first, capacity - room))
                keep(room - fit * length, first, first + full)
                rank, left, first = rank + full * fit, left - full * fit, first + full
            if left and first < end:  # fewer than fill one sequence
                runs.append((length, rank, rank + left, left, first, capacity - room))
                keep(room - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            keep(room, first, end)
    return runs


def best_fit(pieces: DataFrame, capacity: int = SEQUENCE, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` and have no gaps.

    ``pieces`` is read three times and must give the same rows each time (a written table). Pieces of
    a length are ranked within salts of bounded size, and a salt's first rank is the number of pieces
    in the salts before it, so that a length that most pieces have is not one task's work.
    An empty table gives no rows; a length under 1 or over ``capacity`` is an error.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    total = pieces.count()
    salts = max(1, min(4096, total // RANKED))
    salted = pieces.select(*names, F.pmod(F.xxhash64(*[F.col(c) for c in order_by]), F.lit(salts)).cast("int").alias("_salt"))
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    schema = "_length long, _from long, _to long, _fit long, _first long, _at long"
    table = spark.createDataFrame(runs, schema) if runs else spark.createDataFrame([], schema)
    if len(runs) <= PLAN_ROWS:
        table = F.broadcast(table)
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order_by, *[c for c in names if c not in order_by and not isinstance(pieces.schema[c].dataType, BinaryType)])) - 1)
    if salts > 1:
        before = salted.groupBy(F.col(length_col).alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
        before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n"))
        ranked = ranked.join(before, (F.col(length_col) == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(table, (F.col(length_col) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *names,
        (F.col("_first") + F.floor(nth / F.col("_fit"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_fit")) * F.col(length_col)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Documents to packed pieces (see ``token_pieces`` and ``best_fit``); with ``keep_ids`` false, ``ids_crc32`` stands for the ids and spares moving them."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        pieces = pieces.drop("ids")
    return best_fit(scratch.write(pieces, "pieces"), capacity, order_by=(id_col, "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (little-endian uint32) and ``length``. A sequence holds at most ``capacity`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.sum("length").alias("length"))
    return joined


def waste(packed: DataFrame, capacity: int = SEQUENCE) -> float:
    """Share of the sequences' room that holds nothing."""
    n, used = packed.agg(F.countDistinct("sequence_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return 1 - used / (n * capacity) if n else float(np.float64(0))
