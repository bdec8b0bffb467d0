"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

The index is a table of shards of some thousand documents. A shard holds its terms and, for each, blocks of
at most 64 postings: first and last document, greatest impact, and the postings packed by byte. A query is
searched shard by shard, each task carrying the best so far of every query from shard to shard as the
threshold to beat. In a shard, the greatest impacts of the blocks that stand over each document are added up
for all documents at once (the shallow moves); only blocks with a document whose bound reaches the threshold
are unpacked, and only such documents scored.

Scores are whole numbers. The part that does not depend on the query, the impact of a term in a document,
is ``10**9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L`` for n terms in the document, N documents with
terms and L terms in all; a query adds up impact times weight of its terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import scratch
from .terms import Terms
from .tokenizing import slices

BLOCK = 64
#: Documents of a shard, and bytes of their texts, at most (one text may be longer).
SHARD, SHARD_BYTES = 4096, 12 << 20
BEST = 20
#: Queries that go over the index together, and their terms, at most.
QUERIES, QUERY_TERMS = 1000, 200_000
#: Documents of the highest bounds that are scored first in a shard, to raise the threshold.
FIRST = 64
#: Columns of a shard that are arrays: name and type.
ARRAYS = {
    "terms": "<u8", "term_blocks": "<u4", "first": "<u2", "last": "<u2", "count": "u1", "widths": "u1", "most": "<u4", "at": "<u4", "packed": "u1", "lengths": "<u8",
}


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 75 + 25 * n.astype(np.int64) * docs // max(terms, 1)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Shard(NamedTuple):
    """Arrays of ARRAYS, by name; ``lengths`` are terms of each document."""

    terms: np.ndarray
    term_blocks: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    widths: np.ndarray
    most: np.ndarray
    at: np.ndarray
    packed: np.ndarray
    lengths: np.ndarray

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of some blocks: document, frequency, and which of ``blocks``."""
        n = self.count[blocks].astype(np.int64)
        which = np.repeat(np.arange(len(blocks)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        block = blocks[which]
        wide, long = self.widths[block] & 1, self.widths[block] >> 1  # two bytes a document; 1, 2 or 4 a frequency
        begin = self.at[block].astype(np.int64)
        at = begin + place * (1 + wide)
        doc = self.packed[at].astype(np.int64)
        two = np.flatnonzero(wide)
        doc[two] |= self.packed[at[two] + 1].astype(np.int64) << 8
        at = begin + n[which] * (1 + wide) + place * (1 << long)
        tf = self.packed[at].astype(np.int64)
        for byte, least in ((1, 1), (2, 2), (3, 2)):
            more = np.flatnonzero(long >= least)
            tf[more] |= self.packed[at[more] + byte].astype(np.int64) << (8 * byte)
        return doc + self.first[block], tf, which


def build(hashes: np.ndarray, doc: np.ndarray, n_docs: int, docs: int, terms: int) -> Shard:
    """A shard from the hash of each term's occurrence and the document that it is in, documents in order."""
    lengths = np.bincount(doc, minlength=n_docs)
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(h)))
    h, d = h[new], d[new]
    term_at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    df = np.diff(np.append(term_at, len(h)))
    place = np.arange(len(h)) - np.repeat(term_at, df)
    begin = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.append(begin, len(h)))
    block = np.repeat(np.arange(len(begin)), count)
    first, last = d[begin], d[begin + count - 1]
    biggest = np.maximum.reduceat(tf, begin) if len(begin) else tf
    most = np.maximum.reduceat(impacts(tf, lengths[d], docs, terms), begin) if len(begin) else tf
    wide = (last - first > 255).astype(np.int64)
    long = (biggest > 255).astype(np.int64) + (biggest > 65_535)
    size = count * (1 + wide + (1 << long))
    at = np.cumsum(size) - size
    packed = np.zeros(int(size.sum()), np.uint8)
    k = place % BLOCK
    off, to = d - first[block], at[block] + k * (1 + wide[block])
    packed[to] = off & 255
    two = wide[block] == 1
    packed[to[two] + 1] = off[two] >> 8
    to = at[block] + count[block] * (1 + wide[block]) + k * (1 << long[block])
    packed[to] = tf & 255
    for byte, least in ((1, 1), (2, 2), (3, 2)):
        more = long[block] >= least
        packed[to[more] + byte] = (tf[more] >> (8 * byte)) & 255
    term_blocks = np.searchsorted(begin, np.append(term_at, len(h)))
    return Shard(h[term_at], term_blocks, first, last, count, wide | (long << 1), most, at, packed, lengths)


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                k = np.diff(Terms([(t or "").encode() for t in part.column(0).to_pylist()]).first)
                n, total = n + int((k > 0).sum()), total + int(k.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    r = docs.select(text_col).mapInArrow(run, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: ``shard``, ``ids`` and ARRAYS. All documents and all their terms are in it. Shards are numbered by the task that makes them, so this is to be written once and read back."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("shard", LongType()), StructField("ids", ArrayType(docs.schema[id_col].dataType)), *(StructField(c, BinaryType()) for c in ARRAYS)])

    def row(number: int, ids: list[pa.Array], hashes: list[np.ndarray], doc: list[np.ndarray], size: int) -> pa.RecordBatch:
        made = build(np.concatenate(hashes), np.concatenate(doc), size, n_docs, n_terms)
        own = pa.concat_arrays(ids)
        arrays = [pa.array([np.asarray(getattr(made, c)).astype(t).tobytes()], pa.binary()) for c, t in ARRAYS.items()]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *arrays], schema=to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, doc, size, held = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                if size and (size + len(texts) > SHARD or held + sum(map(len, texts)) > SHARD_BYTES):
                    yield row(number, ids, hashes, doc, size)
                    number += 1
                    ids, hashes, doc, size, held = [], [], [], 0, 0
                terms = Terms(texts)
                ids.append(part.column(0))
                hashes.append(terms.hashes())
                doc.append(terms.of_text() + size)
                size, held = size + len(texts), held + sum(map(len, texts))
        if size:
            yield row(number, ids, hashes, doc, size)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[tuple[Any, Shard]]:
    """Row by row: the ids, if ``skip`` is 1, and the shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values if skip else None, Shard(*(np.frombuffer(batch.column(skip + k)[i].as_buffer(), t) for k, t in enumerate(ARRAYS.values())))


def frequencies(built: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Documents that hold each of some terms (sorted hashes), over the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, begin, count = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(("<u8", "<u4", "u1")))
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                if len(terms):
                    upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
                    total += np.where(terms[at] == hashes, upto[begin[at + 1]] - upto[begin[at]], 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    out = np.zeros(len(hashes), np.int64)
    for r in built.select("terms", "term_blocks", "count").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most QUERY_TERMS rows
        out[r.term] = r.n
    return out


class Query:
    """The best so far of one query: ``terms`` are numbers of the searched hashes, ``weights`` theirs times their repeats."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, best: int = BEST):
        self.terms, self.weights, self.best = terms, weights, best
        self.found: list[tuple] = []  # (-score, id is null, id)

    def threshold(self) -> int:
        """Scores under it are of no use; one equal to it may be, by its id."""
        return -self.found[-1][0] if len(self.found) == self.best else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: pa.Array) -> None:
        keep = np.flatnonzero(scores >= self.threshold())
        if len(keep):
            names = ids.take(pa.array(docs[keep])).to_pylist()
            self.found = heapq.nsmallest(self.best, [*self.found, *((-s, i is None, 0 if i is None else i) for s, i in zip(scores[keep].tolist(), names, strict=True))])


def search(shard: Shard, ids: pa.Array, place: np.ndarray, query: Query, docs: int, terms: int, seen: Counter | None = None) -> None:
    """One query in one shard. ``place``: of each searched hash, its number in the shard, or -1. ``seen`` counts postings of the query's terms by what became of them."""
    own = place[query.terms]
    here = np.flatnonzero(own >= 0)
    if not len(here):
        return
    own, w = own[here], query.weights[here]
    begin, end = shard.term_blocks[own].astype(np.int64), shard.term_blocks[own + 1].astype(np.int64)
    n = end - begin
    # All blocks of the query's terms, and the weight and number of the term of each.
    term = np.repeat(np.arange(len(own)), n)
    block = np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n) + begin[term]
    bound = shard.most[block].astype(np.int64) * w[term]
    if seen is not None:
        seen["postings"] += int(shard.count[block].sum())
    starts = np.cumsum(n) - n
    if np.maximum.reduceat(bound, starts).sum() < query.threshold():  # the lists' greatest impacts alone
        return
    size = len(shard.lengths)

    def scored(which: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Scores by document from some of the blocks, unpacked."""
        doc, tf, k = shard.unpack(block[which])
        if seen is not None:
            seen["unpacked"] += len(doc)
        if only is not None:
            keep = only[doc]
            doc, tf, k = doc[keep], tf[keep], k[keep]
        return np.bincount(doc, impacts(tf, shard.lengths[doc], docs, terms) * w[term[which[k]]], size)  # whole numbers under 2 ** 53

    # Shallow: greatest impacts over the documents from each block's first to its last. Lists of one block are as short as a block and taken as they are.
    single = n[term] == 1
    whole = scored(np.flatnonzero(single)) if single.any() else np.zeros(size)
    many = np.flatnonzero(~single)
    first, last = shard.first[block[many]].astype(np.int64), shard.last[block[many]].astype(np.int64)
    steps = np.bincount(first, bound[many], size + 1) - np.bincount(last + 1, bound[many], size + 1)
    bounds = whole + np.cumsum(steps)[:size]
    open_ = np.flatnonzero(bounds >= query.threshold())
    if len(open_) > FIRST:
        top = np.argpartition(-bounds[open_], FIRST)
        rounds = [np.sort(open_[top[:FIRST]]), np.sort(open_[top[FIRST:]])]
    else:
        rounds = [open_]
    for candidates in rounds:
        candidates = candidates[bounds[candidates] >= query.threshold()]
        if not len(candidates):
            continue
        # Deep: blocks that hold a candidate between their first and last document.
        hit = many[np.searchsorted(candidates, first) < np.searchsorted(candidates, last, side="right")]
        only = np.zeros(size, bool)
        only[candidates] = True
        total = whole[candidates] + (scored(hit, only)[candidates] if len(hit) else 0)
        query.offer(total.astype(np.int64), candidates, ids)


def search_index(built: DataFrame, hashes: np.ndarray, weights: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, id_col: str = "doc_id", best: int = BEST) -> DataFrame:
    """Of each task, the best of each query: ``query`` (its place in the list), id, ``score``. ``queries`` have numbers of ``hashes`` and how often each stands."""
    one = built.schema["ids"].dataType.elementType
    schema = StructType([StructField("query", LongType()), StructField(id_col, one), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = [Query(t, weights[t] * n, best) for t, n in queries]
        for ids, shard in _shards(batches, 1):
            if not len(shard.terms):
                continue
            at = np.minimum(np.searchsorted(shard.terms, hashes), len(shard.terms) - 1)
            place = np.where(shard.terms[at] == hashes, at, -1)
            for q in own:
                search(shard, ids, place, q, n_docs, n_terms)
        shape = to_arrow_schema(schema)
        found = [(k, None if null else i, -s) for k, q in enumerate(own) for s, null, i in q.found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], shape.field(j).type) for j in range(3)], schema=shape)

    return built.select("ids", *ARRAYS).mapInArrow(run, schema)


def _blocks(queries: DataFrame, query_col: str, text_col: str) -> Iterator[tuple[list, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Queries in blocks of bounded size: their ids, term numbers and counts, and the hashes that these number."""
    ids, own, terms = [], [], 0

    def block():
        hashes = np.unique(np.concatenate([h for h, _ in own])) if own else np.empty(0, np.uint64)
        return ids, [(np.searchsorted(hashes, h), n) for h, n in own], hashes

    for r in queries.select(F.col(query_col).alias("q"), F.col(text_col).alias("t")).toLocalIterator():
        h, n = np.unique(Terms([(r.t or "").encode()]).hashes(), return_counts=True)
        if ids and (len(ids) >= QUERIES or terms + len(h) > QUERY_TERMS):
            yield block()
            ids, own, terms = [], [], 0
        ids.append(r.q)
        own.append((h, n))
        terms += len(h)
    if ids:
        yield block()


def ranked(
    docs: DataFrame, queries: DataFrame, best: int = BEST, query_col: str = "item_id", query_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The ``best`` documents of each query with a score above 0: query id, ``rank`` from 1, id, ``score``; equal scores by ascending id, null ids last.

    Queries go over the index in blocks of bounded size. Null and empty texts of either side have no terms
    and no rows. Repeated rows of documents are documents of their own, and of queries
    queries of their own. Other columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    n_docs, n_terms = statistics(docs, text_col)
    built = scratch.write(index(docs, n_docs, n_terms, id_col, text_col), "index")
    shape = StructType([StructField("query", LongType()), StructField("_item", queries.schema[query_col].dataType)])
    out = None
    done = 0
    for ids, own, hashes in _blocks(queries, query_col, query_text_col):
        df = frequencies(built, hashes) if len(hashes) else np.empty(0, np.int64)
        weights = np.array([weight(n_docs, int(n)) if n else 0 for n in df], np.int64)
        found = search_index(built, hashes, weights, own, n_docs, n_terms, "_doc", best).withColumn("query", F.col("query") + done)
        names = spark.createDataFrame([(done + k, i) for k, i in enumerate(ids)], shape)
        done += len(ids)
        order = [F.desc("score"), F.asc_nulls_last("_doc")]
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= best).join(F.broadcast(names), "query")  # at most QUERIES rows
        rows = scratch.write(top.select(F.col("_item").alias(query_col), "rank", F.col("_doc").alias(id_col), "score"), "ranked")
        out = rows if out is None else out.union(rows)
    scratch.release(spark, scratch.tables_of(built))
    if out is None:
        return spark.createDataFrame([], StructType([StructField(query_col, queries.schema[query_col].dataType), StructField("rank", IntegerType()), StructField(id_col, docs.schema[id_col].dataType), StructField("score", LongType())]))
    return out

