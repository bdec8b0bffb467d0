"""Removal of repeated lines or paragraphs by hashing.

Units are normalised (Unicode compatibility form, lower case, single spaces), and their 128-bit
digests grouped over the corpus, first in tasks and then globally. The earliest unit of a digest, by
document id and place, stays; all others go, and what stays keeps its offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokenizing import slices

_lines = re.compile(r"[^\n]+")
_paragraphs = re.compile(r"[^\n](?:[^\n]|\n(?!\s*\n))*")


def units(text: str, by: str) -> list[tuple[int, int]]:
    """Start and end (characters) of the units with a word in them."""
    found = (m.span() for m in (_lines if by == "line" else _paragraphs).finditer(text))
    return [(a, b) for a, b in found if not text[a:b].isspace()]


def digest(unit: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unit).lower() if not unit.isascii() else unit.lower()
    return hashlib.blake2b(" ".join(folded.split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def remove_repeated_units(docs: DataFrame, by: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_units``, ``n_removed``, ``removed`` and ``kept`` (unit number, start, end; characters of the original) and ``text`` (the kept units, joined as they were cut).

    ``by`` is "line" or "paragraph" (cut at empty lines). Units without a word are neither counted nor
    kept in the text. Null and empty texts have no units. Rows repeated with id and text count as one
    document, so their units do not go for each other's sake; ids are ranked in their own order, null ids first. Other columns are not read; an empty
    table gives no rows.
    """
    if by not in ("line", "paragraph"):
        raise ValueError(f"unknown unit: {by}")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, unit, digests = [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    for k, (a, b) in enumerate(units(t, by)):
                        at.append(row)
                        unit.append(k)
                        digests.append(digest(t[a:b]))
                rows = pa.array(at, pa.int64())
                high = pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                low = pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(unit, pa.int32()), high, low], names=["id", "rid", "unit", "d1", "d2"])

    placed = scratch.write(named.mapInArrow(cut, f"id {id_type}, rid long, unit int, d1 long, d2 long"), "units")
    # The least place of each digest; counted per (document, unit), so that repeated rows are one.
    first = placed.groupBy("d1", "d2").agg(F.min(F.struct("id", "rid", "unit")).alias("first"), F.max(F.struct("id", "rid", "unit")).alias("last"))
    repeated = first.where("first <> last").select("d1", "d2", F.col("first.rid").alias("rid1"), F.col("first.unit").alias("unit1"))
    gone = placed.join(repeated, ["d1", "d2"]).where("rid <> rid1 or unit <> unit1")
    gone = gone.groupBy("rid").agg(F.collect_set("unit").alias("gone"))  # of one document

    spans = "array<struct<unit:int,start:int,end:int>>"
    kind = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                removed, kept, texts = [], [], []
                for t, out in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out = set(out or ())
                    found = [{"unit": k, "start": a, "end": b} for k, (a, b) in enumerate(units(t, by))]
                    removed.append([u for u in found if u["unit"] in out])
                    kept.append([u for u in found if u["unit"] not in out])
                    texts.append(("\n" if by == "line" else "\n\n").join([t[u["start"] : u["end"]] for u in kept[-1]]))
                n = [pa.array([len(x) for x in y], pa.int64()) for y in (kept, removed)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.add(*n), n[1], pa.array(removed, kind), pa.array(kept, kind), pa.array(texts, pa.string())], names=[id_col, "n_units", "n_removed", "removed", "kept", "text"])

    joined = named.join(gone, "rid", "left").select("id", "text", "gone")
    return joined.mapInArrow(keep, f"`{id_col}` {id_type}, n_units long, n_removed long, removed {spans}, kept {spans}, text string")
