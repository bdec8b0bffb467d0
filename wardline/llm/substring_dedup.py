"""Removal of long repeated strings by sorting suffixes at content-defined anchors.

Two equal strings of ``length`` bytes choose the same anchor in them (the gram with the least hash),
so a string can only be repeated where its anchor's gram is. Each string of a document is left to
its first least gram; an anchor then stands for a range of strings and for the bytes they cover.

1. Anchors, by gram and by hash of all they cover: where two anchors cover the same, every string of
   both is repeated, and nothing more is asked of them. Only one of each kind goes on, and only
   where the gram has several kinds.
2. The covered bytes of those meet by gram, in blocks of bounded size. Suffixes that start at the
   anchor, and the reversed bytes before it, are put in order by deep-shallow sorting; the common
   prefixes of neighbours say, for every place, which strings are equal.
3. Spans of repeated strings are merged per document and cut from its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import scratch
from .anchors import anchors, gram_hashes, sliding_least
from .deep_shallow import common, order
from .textbytes import mix
from .tokenizing import slices

LENGTH = 400
GRAM = 64
#: Anchors of one gram that meet in one block, from each side.
BLOCK = 4000
#: Parts that the anchors covering the same are compared in first.
SALTS = 32


def strings_of_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text: place, hash of the gram, first and last string that are left to it, hash of the bytes these cover."""
    n = len(data) - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    span = length - gram + 1
    at, hashes = anchors(data, length, gram)
    grams = gram_hashes(data, gram)
    least = sliding_least(grams, span)
    # Runs of strings with the same least hash; a run's anchors are those of that hash, each for the strings up to itself.
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    key = np.concatenate([least[first], hashes])
    place = np.concatenate([first, at])
    kind = np.concatenate([np.zeros(len(first), np.int8), np.ones(len(at), np.int8)])
    by = np.lexsort((kind, place, key))
    run = np.maximum.accumulate(np.where(kind[by] == 0, np.arange(len(by)), 0))
    is_anchor = np.flatnonzero(kind[by] == 1)
    owner = by[run[is_anchor]]
    a = place[by][is_anchor]
    h = key[by][is_anchor]
    before = np.concatenate([[-1], np.where(h[1:] == h[:-1], a[:-1], -1)]) if len(a) else a
    low = np.maximum(first[owner], before + 1)
    high = np.minimum(last[owner], a)
    keep = low <= high
    a, h, low, high = a[keep], h[keep], low[keep], high[keep]
    # Hash of the covered bytes from the hashes of grams laid end to end, the last one flush with the end.
    end = high + length - gram
    covered = mix((a - low).astype(np.uint64) * np.uint64(1 << 20) + (a - high).astype(np.uint64))
    for k in range(0, length + span, gram):
        p = np.minimum(low + k, end)
        covered = mix(covered * np.uint64(0x9E3779B97F4A7C15) + grams[p])
    return a, h, low, high, covered


def repeated(contexts: list[tuple[int, int, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """Per context (least and greatest distance of its strings' starts before the anchor, covered bytes): ranges of distances at which its string equals another's."""
    m = len(contexts)
    left = [c[: d][::-1] for _, d, c in contexts]
    right = [c[d:] for _, d, c in contexts]
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        back, on = common(*left), common(*right)
        for j, (low, high, _) in enumerate(contexts):
            if (a := max(low, length - on)) <= (b := min(high, back)):
                out[j].append((a, b))
        return out
    by_left, by_right = np.array(order(left)), np.array(order(right))
    lcp_left = np.array([common(left[x], left[y]) for x, y in zip(by_left[:-1], by_left[1:], strict=True)])
    lcp_right = np.array([common(right[x], right[y]) for x, y in zip(by_right[:-1], by_right[1:], strict=True)])
    low, high = np.array([c[0] for c in contexts]), np.array([c[1] for c in contexts])
    # Classes change only where a distance passes a common prefix.
    marks = np.unique(np.concatenate([[0], lcp_left + 1, length - lcp_right, low, high + 1]))
    marks = marks[(marks >= low.min()) & (marks <= high.max() + 1)]
    left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for d, after in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
        left_class[by_left] = np.concatenate([[0], np.cumsum(lcp_left < d)])
        right_class[by_right] = np.concatenate([[0], np.cumsum(lcp_right < length - d)])
        own = np.flatnonzero((low <= d) & (high >= d))
        _, kind, count = np.unique(left_class[own] * m + right_class[own], return_inverse=True, return_counts=True)
        for j in own[count[kind] > 1].tolist():
            if out[j] and out[j][-1][1] == d - 1:
                out[j][-1] = (out[j][-1][0], after - 1)
            else:
                out[j].append((d, after - 1))
    return out


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``rid``, ``start`` and ``end`` of spans of repeated strings in ``docs`` (rid, text); spans of a document may overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rid, cols = [], [[], [], [], [], []]
                for r, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = strings_of_anchors(np.frombuffer(t or b"", np.uint8), length, gram)
                    rid.append(np.full(len(found[0]), r, np.int64))
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                a, h, low, high, u = (np.concatenate(c) for c in cols)
                arrays = [np.concatenate(rid), a.astype(np.int32), h.view(np.int64), (a - low).astype(np.int16), (a - high).astype(np.int16), u.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["rid", "a", "h", "far", "near", "u"])

    found = docs.select("rid", "text").mapInArrow(find, "rid long, a int, h long, far short, near short, u long")
    # Who covers the same as another: first within salts, so that no kind is one task's work, then one row a salt.
    # lag and lead hold one row at a time.
    salted = Window.partitionBy("h", "u", F.pmod("rid", F.lit(SALTS))).orderBy("rid", "a")
    found = found.select("*", F.lag("a").over(salted).isNull().alias("first"), F.lead("a").over(salted).isNull().alias("last"))
    found = scratch.write(found, "anchors")
    kind = Window.partitionBy("h", "u").orderBy("rid", "a")
    heads = found.where("first").select("*", F.lag("a").over(kind).isNull().alias("only1"), F.lead("a").over(kind).isNull().alias("only2"))
    heads = heads.select("rid", "a", "h", "far", "near", F.expr("not (last and only1 and only2)").alias("known"), F.col("only1").alias("speaks"))
    heads = scratch.write(heads.where("known or speaks"), "heads")
    span = ["rid", (F.col("a") - F.col("far")).alias("start"), (F.col("a") - F.col("near") + length).alias("end")]
    whole = found.where("not first").select(*span).union(heads.where("known").select(*span))

    kinds = heads.where("speaks").groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = heads.where("speaks").join(kinds, "h").select("rid", "h", "a", "far", "near", "known", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("parts"))
    asked = scratch.write(asked, "kinds")
    of_doc = asked.groupBy("rid").agg(F.collect_list(F.struct("h", "a", "far", "near", "known", "parts")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for r, t, xs in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out += [(r, x["h"], x["a"], x["far"], x["near"], x["known"], x["parts"], t[x["a"] - x["far"] : x["a"] - x["near"] + length]) for x in xs]
                names = ["rid", "h", "a", "far", "near", "known", "parts", "bytes"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    contexts = docs.select("rid", "text").join(of_doc, "rid").mapInArrow(cut, "rid long, h long, a int, far short, near short, known boolean, parts int, bytes binary")
    contexts = contexts.withColumn("part", F.pmod(F.xxhash64("rid", "a"), F.col("parts")).cast("int"))
    contexts = contexts.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    contexts = contexts.select("h", F.least("part", "other").alias("b1"), F.greatest("part", "other").alias("b2"), "rid", "a", "far", "near", "known", "bytes")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, out = [], None, []

        def block() -> None:
            if len(rows) < 2:
                return
            for (r, a, _, _, known, _), ranges in zip(rows, repeated([(x[3], x[2], x[5]) for x in rows], length), strict=True):
                out.extend((r, a - high, a - low + length) for low, high in ranges if not known)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2))], names=["rid", "start", "end"])
            out.clear()
            return made

        for batch in batches:
            for h, b1, b2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, b1, b2) != key:
                    block()
                    rows, key = [], (h, b1, b2)
                rows.append(row)
            if len(out) > 10_000:
                yield flush()
        block()
        yield flush()

    keys = ["h", "b1", "b2"]
    partial = contexts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sort, "rid long, start int, end int")
    return whole.union(partial)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, least_words: int = 0, joint: str = "") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``spans`` (start and end of the maximal removed runs, in UTF-8 bytes) and ``kept`` (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same
    document or another; strings do not cross documents and are judged on the input. So every copy
    goes, and rows repeated under one id are copies of each other. Null texts are empty; texts under
    ``length`` bytes stay as they are. With ``least_words``, a run of such bytes goes only if it holds
    so many pieces between ASCII white space; ``joint`` stands in ``kept`` where a run was inside a text. Null ids pass through, other columns are not read, and an empty
    table gives no rows. ``carry`` names a column of ``docs`` that comes through unchanged. ``gram`` must be a power of two, under ``length``.
    """
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("kept", BinaryType()),
        *([StructField(carry, docs.schema[carry].dataType)] if carry else []),
    ])
    carried = [F.col(carry)] if carry else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"), *carried)
    spans = repeated_spans(named, length, gram).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.write(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, gone, runs, kept = [], [], [], []
                for t, xs in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own: list[list[int]] = []
                    for x in sorted((x["start"], x["end"]) for x in xs or ()):
                        if own and x[0] <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], x[1])
                        else:
                            own.append(list(x))
                    if least_words:
                        own = [r for r in own if len(t[r[0] : r[1]].split()) >= least_words]
                    ends = [0, *(e for _, e in own)]
                    starts = [*(s for s, _ in own), len(t)]
                    n.append(len(t))
                    gone.append(sum(e - s for s, e in own))
                    runs.append([{"start": s, "end": e} for s, e in own])
                    kept.append(joint.encode().join([t[a:b] for a, b in zip(ends, starts, strict=True) if a < b or not joint]))
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, spans_type), pa.array(kept, pa.binary()), *part.columns[3:]], names=schema.names)

    return named.join(spans, "rid", "left").select("_id", "text", "spans", *carried).mapInArrow(cut, schema)


def whole_characters(column: str):
    """The text of UTF-8 bytes of which a cut may have left parts of characters: those go, whole characters stay."""
    return F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("\uFFFD"), F.lit(""))
