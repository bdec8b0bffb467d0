"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and word pairs are hashed into buckets. One bucket model is counted over all documents (raw),
one over a bounded sample of labelled documents of the wanted kind (target). A document's log weight
is the sum, over its n-grams, of log target minus log raw. Adding Gumbel noise to the weights and
taking the k greatest samples k documents without replacement in proportion to their weights. Sums grow
with the text, so that the longest would always win: where k is not given, a document's weight is taken by
n-gram and times the mean length of labelled documents, as if all texts were of that length, and k is
the number of documents that reach the bound which tells labelled documents that the model has not seen apart best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import scratch
from .labelled import remainder, sample, with_labels
from .textbytes import mix, word_hashes
from .tokenizing import slices
from .toxicity import texts_in

BUCKETS = 10_000
#: Labelled rows that the target model is counted from at most.
LABELLED = 20_000
#: n-grams that the target model takes over from the raw model, in proportion: what so few labelled rows never show is not taken for unwanted.
SMOOTHING = 10_000.0
#: Share of the labelled target documents that the bound is set to keep where none of the other kind are labelled.
KEEP_TARGET = 0.999
#: Added to a log weight before it is taken by n-gram, so that texts too short to tell stay.
ROOM = 3.0
BINS = 4096


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbouring words, and the text it is in."""
    words, first = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    both = text[1:] == text[:-1]
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[both]
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text[:-1][both]])


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """n-grams of all texts by bucket, added up in each task and then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(ngram_buckets(texts_in(part, 0))[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    q = (raw + 1) / (raw + 1).sum()
    p = (target + SMOOTHING * q) / (target.sum() + SMOOTHING)
    return np.log(p) - np.log(q)


def gumbel(*key: Column) -> Column:
    """Gumbel noise that is a function of the key: the same on every run and executor."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit("gumbel")), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """Per row: id, ``n_ngrams``, ``log_weight`` and ``perturbed`` (with Gumbel noise by id and text)."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("_noise", DoubleType()), StructField("n_ngrams", LongType()), StructField("log_weight", DoubleType())])
    if carry:
        schema = schema.add(StructField(carry, docs.schema[carry].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, text = ngram_buckets(texts_in(part, 2))
                n = np.bincount(text, minlength=part.num_rows)
                w = np.bincount(text, weights=ratio[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(w.astype(np.float64)), *part.columns[3:]], names=schema.names)

    noise = gumbel(F.col(id_col).cast("string"), F.col(text_col))
    carried = [F.col(carry)] if carry else []
    found = docs.select(F.col(id_col), noise.alias("_noise"), F.col(text_col).alias("_text"), *carried).mapInArrow(run, schema)
    return found.select(id_col, "n_ngrams", "log_weight", (F.col("log_weight") + F.col("_noise")).alias("perturbed"), *carried)


def threshold_of_top(values: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value of a column, exactly: bins between the bounds are counted, and the bin that holds it is cut into bins anew.

    Only BINS counts reach the driver in each round. ``-inf`` if there are at most k rows, ``inf`` for k < 1.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1:
        return float("inf")
    if k >= n:
        return float("-inf")
    above = 0
    while high > low:
        width = (high - low) / BINS
        if low + width <= low or high - width >= high:
            break
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width))).cast("int")
        rows = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if above + r.n >= k:
                low, high = r.low, r.high
                if above + r.n == k:
                    return low
                break
            above += r.n
    return low


def per_ngram() -> Column:
    """The log weight by n-gram, without noise."""
    return (F.col("log_weight") + ROOM) / F.greatest(F.col("n_ngrams"), F.lit(1))


def best_bound(score: np.ndarray, wanted: np.ndarray, keep_target: float) -> float:
    """The bound that best parts scores of wanted rows (at or over it) from others: the share of others under it less that of wanted ones is greatest.

    It lies midway between two scores. With wanted rows alone, their quantile that keeps ``keep_target``; with none, ``-inf``.
    """
    if not wanted.any():
        return float("-inf")
    if wanted.all():
        return float(np.quantile(score, 1 - keep_target))
    order = np.argsort(score, kind="stable")
    score, wanted = score[order], wanted[order]
    gain = np.cumsum(~wanted)[:-1] / (~wanted).sum() - np.cumsum(wanted)[:-1] / wanted.sum()
    gain[score[1:] == score[:-1]] = -2
    i = int(np.argmax(gain))
    return float((score[i] + score[i + 1]) / 2) if gain[i] > 0 else float("-inf")


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, label_col: str = "quality", target: int = 1, labelled: int = LABELLED,
    keep_target: float = KEEP_TARGET, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None,
) -> DataFrame:
    """Per row: id, ``n_ngrams``, ``log_weight``, ``perturbed`` (the weight with Gumbel noise) and ``kept``.

    ``kept`` is whether the perturbed weight is among the k greatest; ties at the k-th (rows repeated
    with their id) are all kept. With ``k``, the weight is ``log_weight``. Without, it is the weight by n-gram (see
    ``per_ngram``) times the mean number of n-grams of labelled documents, and k is the number of documents whose weight by n-gram, without
    noise, reaches the bound which best parts labelled target documents from other labelled ones (with target
    documents alone, the bound that the share ``keep_target`` of them reaches). Which documents these k are is drawn: one near the bound may go for one below it. The raw model is
    counted over all documents, the target model over one half of at most ``labelled`` labelled rows;
    the other half sets bound and length. Null and empty texts have weight 0 and take part as such. Without labels of the wanted kind all weights are 0 and, with no ``k``, everything is kept. ``carry`` names a column of ``docs`` that comes through unchanged. Null ids and
    extra columns pass without effect, an empty table gives no rows.
    """
    known = with_labels(docs, sample(labels, label_col, labelled, id_col), id_col, text_col)
    # One half of the labelled documents makes the model; the other, which it has not seen, chooses the bound.
    half = remainder("_id", 2)
    p = bucket_counts(known.where((half == 0) & (F.col("y") == target)), "text")
    ratio = log_ratio(p, bucket_counts(docs, text_col)) if p.sum() else np.zeros(BUCKETS)
    bound, length = float("-inf"), None
    if k is None and p.sum():
        own = weigh(known.where(half == 1), ratio, "_id", "text", carry="y").select(per_ngram().alias("s"), "n_ngrams", "y").toArrow()  # at most ``labelled`` rows
        if own.num_rows:
            bound = best_bound(own.column("s").to_numpy(), own.column("y").to_numpy() == target, keep_target)
            length = float(own.column("n_ngrams").to_numpy().mean())

    def drawn(carry: str | None = None) -> DataFrame:
        weights = weigh(docs, ratio, id_col, text_col, carry)
        if length is None:
            return weights
        return weights.withColumn("perturbed", F.lit(length) * per_ngram() + (F.col("perturbed") - F.col("log_weight")))

    ranks = scratch.write(drawn().select("perturbed", per_ngram().alias("plain")), "ranks")
    if k is None:
        k = ranks.where(F.col("plain") >= F.lit(bound)).count()
    least = threshold_of_top(ranks, "perturbed", k)
    scratch.release(docs.sparkSession, scratch.tables_of(ranks))
    return drawn(carry).withColumn("kept", F.col("perturbed") >= F.lit(least))
