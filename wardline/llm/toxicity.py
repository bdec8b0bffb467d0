"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples, without punctuation around them; a word that no example has is in
no vector. Document frequencies are counted over all documents. A term's weight is its TF-IDF, times
how surely it is commoner under label 1 (1 for most terms): without this factor a few telling words
are lost among hundreds of others. The examples' vectors make an inverted index in blocks of
examples, with the greatest weight of each term in each block. A search visits the block of the
greatest upper bound, then the blocks that could still hold a nearer example and no others, so that
its neighbours are exactly the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .labelled import labelled, picked, remainder, with_labels
from .textbytes import Words
from .tokenizing import forget_tokenizers, give_back, slices

#: Examples of either label at most. Votes are weighted by the share of its label's rows that an example stands for.
EXAMPLES = 2048
#: Standard errors that a term's log odds under label 1 are lowered by before they count.
SURE = 2.0
NEIGHBOURS = 15
BLOCK = 256
#: Weight of the prior (the share of label 1) among the votes.
PRIOR_VOTES = 0.1
#: ASCII punctuation that is no part of a word at its ends.
AROUND = b"!\"'(),-.:;?[]_`{}~"
#: Texts whose neighbours a task remembers.
REMEMBERED = 5_000
#: Bytes of text that a task has in arrays at once, about: these take some thirty times as much, beside the index.
AT_ONCE = 2 << 20


def terms_of(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs and their counts; with ``wanted`` (sorted hashes), terms are places in it and others are left out."""
    words = Words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    words.strip(AROUND)
    own = words.ends > words.starts
    h, t = words.hashes()[own], text[own]
    if wanted is None:
        values, h = np.unique(h, return_inverse=True)
    else:
        values = wanted
        at = np.searchsorted(wanted, h)
        at[at == len(wanted)] = 0
        hit = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
        h, t = at[hit], t[hit]
    pairs, counts = np.unique(t * max(1, len(values)) + h, return_counts=True)
    row, term = np.divmod(pairs, max(1, len(values)))
    return row, term if wanted is not None else values[term], counts


def texts_in(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]


def example_terms(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every term of the examples (hashes, sorted): in how many of label 1 and of label 0 it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096, AT_ONCE):
                row, term, _ = terms_of(texts_in(part, 0))
                y = np.array(part.column(1).to_pylist(), np.int64)
                h, at = np.unique(term, return_inverse=True)
                ones = np.bincount(at, weights=y[row], minlength=len(h)).astype(np.int64)
                every = np.bincount(at, minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ones), pa.array(every - ones)], names=["h", "a", "b"])

    table = train.select("text", "y").mapInArrow(count, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()  # terms of 2 * ``examples`` texts
    h, a, b = (np.asarray(table.column(c).combine_chunks()) if table.num_rows else np.empty(0, np.int64) for c in ("h", "a", "b"))
    h = h.view(np.uint64)
    by = np.argsort(h)
    return h[by], a[by], b[by]


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """1, and more for a term that is surely commoner under label 1: its log odds less SURE standard errors, squared."""
    a, b, c, d = a + 0.5, b + 0.5, n1 - a + 0.5, n0 - b + 0.5
    odds = np.log(a * d / (b * c)) - SURE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return 1 + np.maximum(0, odds) ** 2


def document_frequencies(docs: DataFrame, wanted: np.ndarray, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        found, n = np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, most_bytes=AT_ONCE):
                found += np.bincount(terms_of(texts_in(part, 0), wanted)[1], minlength=len(wanted))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen])), pa.array(np.concatenate([[n], found[seen]]))], names=["term", "n"])

    out = np.zeros(len(wanted) + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term
        out[r.term + 1] = r.n
    return out[1:], int(out[0])


@dataclass
class BlockMaxIndex:
    """Postings by term and then example; ``pointer[t, b]`` is where those of term t in block b start, ``greatest[t, b]`` a bound of their weights."""

    example: np.ndarray
    weight: np.ndarray
    pointer: np.ndarray
    greatest: np.ndarray
    label: np.ndarray
    ids: list

    @staticmethod
    def build(rows: list[tuple[object, int, np.ndarray, np.ndarray]], terms: int) -> BlockMaxIndex:
        """``rows``: id, label, terms and weights (of unit length) of each example. Examples alike in their heaviest term stand together, so that bounds are tight."""
        rows = sorted(rows, key=lambda r: (r[1], int(r[2][np.argmax(r[3])]), str(r[0])))
        n = len(rows)
        blocks = -(-n // BLOCK)
        example = np.repeat(np.arange(n), [len(r[2]) for r in rows]) if n else np.empty(0, np.int64)
        term = np.concatenate([r[2] for r in rows]) if n else np.empty(0, np.int64)
        weight = np.concatenate([r[3] for r in rows]) if n else np.empty(0)
        by = np.lexsort((example, term))
        example, term, weight = example[by], term[by], weight[by]
        cell = term * max(1, blocks) + example // BLOCK
        size = np.bincount(cell, minlength=terms * max(1, blocks))
        pointer = np.zeros((terms, blocks + 1), np.int32)
        if blocks:
            ends = np.cumsum(size).reshape(terms, blocks)
            pointer[:, 1:], pointer[:, 0] = ends, ends[:, 0] - size.reshape(terms, blocks)[:, 0]
        greatest = np.zeros(terms * max(1, blocks), np.float32)
        np.maximum.at(greatest, cell, np.nextafter(weight.astype(np.float32), np.float32(2)))
        return BlockMaxIndex(example.astype(np.int32), weight, pointer, greatest.reshape(terms, max(1, blocks))[:, :blocks], np.array([r[1] for r in rows], np.int64), [r[0] for r in rows])

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """With every example, those outside ``blocks`` counting as 0."""
        whole = len(blocks) == self.greatest.shape[1]
        starts, ends = (self.pointer[terms, 0], self.pointer[terms, -1]) if whole else (self.pointer[np.ix_(terms, blocks)].ravel(), self.pointer[np.ix_(terms, blocks + 1)].ravel())
        size = (ends - starts).astype(np.int64)
        place = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        w = np.repeat(weights if whole else np.repeat(weights, len(blocks)), size)
        return np.bincount(self.example[place], weights=w * self.weight[place], minlength=len(self.ids))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0 (ties to the lower number), and their cosines."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(terms) or not self.greatest.shape[1]:
            return none
        bounds = weights @ self.greatest[terms]
        first = int(np.argmax(bounds))
        score = self.cosines(terms, weights, np.array([first]))
        least = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        others = np.flatnonzero((bounds >= least * (1 - 1e-9)) & (bounds > 0) & (np.arange(len(bounds)) != first))
        if len(others) + 1 == len(bounds):
            score = self.cosines(terms, weights, np.arange(len(bounds)))
        elif len(others):
            score += self.cosines(terms, weights, others)
        found = np.flatnonzero(score >= max(np.partition(score, -k)[-k], 1e-300)) if len(score) > k else np.flatnonzero(score > 0)
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]


def vectors(row: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of unit length, by text; ``weight`` is of one occurrence of each term."""
    w = (1 + np.log(count)) * weight[term]
    length = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
    w = w / length[row]
    ends = np.searchsorted(row, np.arange(n + 1))
    return [(term[a:b], w[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_mod: int = 5, examples: int = EXAMPLES,
    neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None,
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5) and ``evidence`` (nearest examples: id, cosine, label).

    Labels are learnt from at most ``examples`` labelled rows of either label whose crc32(id as text)
    modulo ``held_out_mod`` is not 0. Texts without a term of an example (null, empty, of unknown words) get the
    share of label 1 among all labelled rows of that kind, as does every text where not both labels
    are there (0 without labels). Rows repeated, null ids and extra columns change nothing in a row's score; an empty
    table gives no rows.
    """
    rows = labelled(labels.where(remainder(id_col, held_out_mod) != 0), label_col, id_col)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.0
    sampled = picked(rows.where("y = 0"), examples).union(picked(rows.where("y = 1"), examples))
    train = with_labels(docs, sampled, id_col, text_col)
    own = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    both = bool(own.get(0) and own.get(1))
    wanted, a, b = example_terms(train) if both else (np.empty(0, np.uint64), np.empty(0), np.empty(0))
    df, total = document_frequencies(docs, wanted, text_col) if both else (np.empty(0, np.int64), 0)
    weight = (np.log((1 + total) / (1 + df)) + 1) * relevance(a, b, own.get(1, 0), own.get(0, 0))
    stands_for = np.array([n.get(y, 0) / max(1, own.get(y, 0)) for y in (0, 1)])

    def vectorize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes=AT_ONCE):
                found = vectors(*terms_of(texts_in(part, 1), wanted), weight, part.num_rows)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in found]), kind)) for k, kind in enumerate((pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["_id", "y", "t", "w"])

    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("_id", id_type), StructField("y", IntegerType()), StructField("t", ArrayType(LongType())), StructField("w", ArrayType(DoubleType()))])
    rows = []
    if both:
        made = train.select("_id", "text", "y").mapInArrow(vectorize, schema).where(F.size("t") > 0).toArrow()  # at most 2 * ``examples`` rows
        for part in made.to_batches():
            ends = np.asarray(part.column(2).offsets)
            t, w = (np.asarray(part.column(k).values) for k in (2, 3))
            rows += [(i, y, t[a:b].copy(), w[a:b].copy()) for i, y, a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        del made
    index = BlockMaxIndex.build(rows, len(wanted))
    del rows
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index
    give_back()  # the driver has no further use for what it made the index of

    evidence = ArrayType(StructType([StructField(id_col, id_type), StructField("cosine", DoubleType()), StructField("label", IntegerType())]))
    schema = StructType([
        StructField(id_col, id_type), StructField("held_out", BooleanType()), StructField("score", DoubleType()),
        StructField("predicted", IntegerType()), StructField("evidence", evidence), *([StructField(carry, docs.schema[carry].dataType)] if carry else []),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        index = shared.value
        known: dict[tuple, tuple[float, list]] = {}
        for batch in batches:
            for part in slices(batch, most_bytes=AT_ONCE):
                scores, found = [], []
                for t, w in vectors(*terms_of(texts_in(part, 1), wanted), weight, part.num_rows):
                    if len(t) == 0:
                        scores.append(share)
                        found.append([])
                        continue
                    key = (hash(t.tobytes()), hash(w.tobytes()), len(t))
                    if key not in known:
                        if len(known) > REMEMBERED:
                            known.clear()
                        near, cosine = index.nearest(t, w, neighbours)
                        # A vote counts by its nearness and by how many labelled rows it stands for.
                        label = index.label[near]
                        vote = cosine**2 / (1.0001 - np.minimum(cosine, 1)) * stands_for[label]
                        known[key] = (
                            float((vote @ label + PRIOR_VOTES * share) / (vote.sum() + PRIOR_VOTES)),
                            [{id_col: index.ids[x], "cosine": float(c), "label": int(y)} for x, c, y in zip(near[:3], cosine[:3], label[:3], strict=True)],
                        )
                    scores.append(known[key][0])
                    found.append(known[key][1])
                arrays = [part.column(0), part.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                arrays.append(pa.array(found, pa.list_(pa.struct([(id_col, part.column(0).type), ("cosine", pa.float64()), ("label", pa.int32())]))))
                yield pa.RecordBatch.from_arrays([*arrays, *part.columns[3:]], names=schema.names)

    carried = [F.col(carry)] if carry else []
    return docs.select(F.col(id_col), F.col(text_col).alias("_text"), (remainder(id_col, held_out_mod) == 0).alias("_h"), *carried).mapInArrow(score, schema)
