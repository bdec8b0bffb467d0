"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by scaled forward recursion.

States emit classes. The most frequent words are classes of their own; all other words share classes
by their last bytes, and within its class a word has its smoothed share of the class's training
tokens. So the model has a bounded number of parameters, and every word, known or not, a probability.

1. Words of the training documents are counted in tasks and then over the corpus.
2. Every text becomes a row of class numbers, written once. What its rarer words need from the
   corpus counts comes by a join on the word.
3. Each training round adds up expected counts in tasks and then over partitions.
4. A document's likelihood: its class numbers in segments, each segment's transfer matrix by scaled
   forward steps from every state, and the matrices multiplied in order. No text is cut short.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .labelled import remainder
from .tokenizing import slices
from .toxicity import texts_in

WORDS = 32_000
TAILS = 1024
STATES = 8
ROUNDS = 3
SEGMENT = 256
#: Tokens of the unigram model mixed into each state's emissions.
PRIOR = 1000.0
ADD = 0.1
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
END = ""


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def tail(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


@dataclass
class Hmm:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states), rows sum to 1
    emit: np.ndarray  # (classes, states), columns sum to 1

    @staticmethod
    def initial(share: np.ndarray, states: int) -> Hmm:
        """Sticky states whose emissions are the classes' shares, shaken a little so that they part."""
        rng = np.random.default_rng(11)
        emit = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), states)))
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), step, emit / emit.sum(0))

    def expected(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, steps and emissions in sequences (each shorter than a few hundred), by scaled forward and backward passes."""
        k = len(self.start)
        ids = sorted((x for x in ids if len(x)), key=len, reverse=True)
        starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        if not ids:
            return starts, steps, emits
        lengths = np.array([len(x) for x in ids])
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
        at = np.concatenate([[0], np.cumsum(active)])
        flat = np.empty(at[-1], np.int64)
        t_of = np.concatenate([np.arange(n) for n in lengths])
        s_of = np.repeat(np.arange(len(ids)), lengths)
        flat[at[t_of] + s_of] = np.concatenate(ids)
        seen = self.emit[flat]
        alpha, scale = np.empty_like(seen), np.empty(len(flat))
        for t in range(longest):
            a, b = at[t], at[t + 1]
            x = (self.start[None, :] if t == 0 else alpha[at[t - 1] : at[t - 1] + b - a] @ self.step) * seen[a:b]
            scale[a:b] = x.sum(1)
            alpha[a:b] = x / scale[a:b, None]
        beta = np.ones_like(seen)
        for t in range(longest - 2, -1, -1):
            a, b = at[t + 1], at[t + 2]
            ahead = seen[a:b] * beta[a:b] / scale[a:b, None]
            beta[at[t] : at[t] + b - a] = ahead @ self.step.T
            steps += alpha[at[t] : at[t] + b - a].T @ ahead
        gamma = alpha * beta
        for z in range(k):
            emits[:, z] = np.bincount(flat, weights=gamma[:, z], minlength=len(self.emit))
        return gamma[: at[1]].sum(0), steps * self.step, emits

    def updated(self, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Hmm:
        start, step = starts + 0.1, steps + 0.1
        emit = emits + PRIOR * share[:, None]
        return Hmm(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    def log10s(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 of each whole sequence's probability; 0 for an empty one."""
        k, eye = len(self.start), np.eye(len(self.start))
        lengths = np.array([len(x) for x in ids])
        parts = -(-lengths // SEGMENT)
        pieces = [x[a : a + SEGMENT] for x in ids for a in range(0, len(x), SEGMENT)]
        if not pieces:
            return np.zeros(len(ids))
        opens = np.concatenate([np.arange(n) == 0 for n in parts])
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        size = np.array([len(pieces[i]) for i in order])
        padded = np.zeros((len(pieces), int(size[0])), np.int64)
        for row, i in enumerate(order):
            padded[row, : size[row]] = pieces[i]
        # Row r of a segment's matrix is the forward vector that starts in state r; one scale for the matrix.
        matrix = np.broadcast_to(eye, (len(pieces), k, k)).copy()
        scale = np.zeros(len(pieces))
        first = opens[order]
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))
            x = (matrix[:n].reshape(n * k, k) @ self.step).reshape(n, k, k)
            if t == 0:
                x[first[:n]] = eye  # a document's first token takes no step
            x *= self.emit[padded[:n, t]][:, None, :]
            total = x.sum((1, 2))
            matrix[:n] = x / total[:, None, None]
            scale[:n] += np.log(total)
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        begin = np.concatenate([[0], np.cumsum(parts)])[:-1]
        vector, found = np.repeat(self.start[None, :], len(ids), 0), np.zeros(len(ids))
        for s in range(int(parts.max())):
            own = np.flatnonzero(parts > s)
            rows = place[begin[own] + s]
            x = np.einsum("ij,ijk->ik", vector[own], matrix[rows])
            total = x.sum(1)
            vector[own] = x / total[:, None]
            found[own] += np.log(total) + scale[rows]
        return found / np.log(10)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` and ``c`` over all texts, with the end of each text as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
            found.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for t in texts_in(part, 0):
                    found.update(tokens(t))
                found[END.encode()] += part.num_rows
                if len(found) > COUNTED:
                    yield handed()
        yield handed()

    return docs.select(text_col).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(
    docs: DataFrame, held_out_mod: int = 10, words: int = WORDS, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score`` (the model), log10.

    Learns from rows whose crc32(id as text; a null id is the empty text) modulo ``held_out_mod`` is
    not 0. A text's tokens are its words and one end, so null and empty texts have one token. Words
    never seen share one unknown word of their class. Rows repeated under an id count each time they
    stand; extra columns are not read; without training rows a model of equal shares scores the rest, and an empty table
    gives no rows.
    """
    if words + TAILS > 1 << 16:
        raise ValueError("class numbers are stored in 16 bits")
    spark = docs.sparkSession
    held = remainder(id_col, held_out_mod) == 0
    counts = scratch.write(count_words(docs.where(~held), text_col), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = np.log10(n + ADD * (v + 1))
    # The greatest count bound that leaves at most ``words`` words, from a histogram of a few thousand bins: only words over it reach the driver.
    size = F.floor(F.log2(F.col("c")) * 64).cast("int")
    bins = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    reached = np.cumsum([b.n for b in bins])
    fits = int(np.searchsorted(reached, words, side="right"))
    top = [(r.word, r.c) for r in counts.where(size >= bins[fits - 1]["size"]).collect()] if fits else []  # ``words`` rows at most
    top.sort(key=lambda x: (-x[1], x[0]))
    if all(w != END for w, _ in top):
        top = [*top[: words - 1], (END, next((r.c for r in counts.where(F.col("word") == END).collect()), 0))]
    least = min((c for w, c in top if w != END), default=n)
    own_class = {w.encode(): i for i, (w, _) in enumerate(top)}
    known = np.array([c for _, c in top], np.float64)
    listed = spark.createDataFrame([(w,) for w, _ in top], "word string")
    others = counts.where(F.col("c") <= least).join(F.broadcast(listed), "word", "left_anti")
    tail_of = (F.crc32(F.expr("substring(cast(word as binary), -3, 3)")) % TAILS).cast("int")
    tails = {r.t: (r.c, r.v) for r in others.groupBy(tail_of.alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # TAILS rows at most
    mass = np.array([tails.get(t, (0, 0))[0] + ADD * (tails.get(t, (0, 0))[1] + 1) for t in range(TAILS)])
    share = np.concatenate([known + ADD, mass])
    share /= share.sum()
    base_of = np.log10(known + ADD)
    known_of = known > 0
    m = len(top)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for t in texts_in(part, 3):
                    ws = [*tokens(t), b""]
                    ids = [own_class.get(w, -1) for w in ws]
                    x = np.array(ids, np.int64)
                    other = [ws[i] for i in np.flatnonzero(x < 0).tolist()]
                    top_ids = x[x >= 0]
                    x[x < 0] = [m + tail(w) for w in other]
                    rare = Counter(other)
                    out[0].append(len(ws))
                    out[1].append(int(known_of[top_ids].sum()))
                    out[2].append(float(base_of[top_ids].sum()))
                    out[3].append(x.astype(np.uint16).tobytes())
                    out[4].append(rare)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in out[4]])]).astype(np.int32)
                flat = pa.array([w for r in out[4] for w in r], pa.binary()).cast(pa.string())
                times = pa.array([c for r in out[4] for c in r.values()], pa.int32())
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([flat, times], names=["word", "times"]))
                arrays = [part.column(0), part.column(1), part.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.binary()), rare]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "held", "n_tokens", "n_top", "base_top", "ids", "rare"])

    id_type = docs.schema[id_col].dataType.simpleString()
    coded = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    coded = coded.mapInArrow(encode, f"row long, id {id_type}, held boolean, n_tokens long, n_top long, base_top double, ids binary, rare array<struct<word:string,times:int>>")
    coded = scratch.write(coded, "coded")

    model = Hmm.initial(share, states)
    for _ in range(rounds if n else 0):
        model = trained(coded.where("not held").select("ids"), model, share)

    shared = model

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024, 1 << 20):
                found = shared.log10s([np.frombuffer(x, np.uint16) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["row", "model"])

    likelihood = coded.select("row", "ids").mapInArrow(forward, "row long, model double")
    # Rarer words: how often the corpus has them, and their share of their class.
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    masses = spark.createDataFrame(list(enumerate(np.log10(mass).tolist())), "t int, log_mass double")
    rare = rare.withColumn("t", tail_of).join(F.broadcast(masses), "t")
    log_c = F.log10(F.col("c") + ADD)
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * log_c).alias("base_rare"), F.sum(F.col("times") * (log_c - F.col("log_mass"))).alias("in_class")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        coded.select("row", "id", "held", "n_tokens", "n_top", "base_top")
        .join(likelihood, "row")
        .join(rare, "row", "left")
        .select(
            F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_top") + zero("n_rare")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base_top") + zero("base_rare") - F.col("n_tokens") * F.lit(float(denominator))).alias("base_score"),
            (F.col("model") + zero("in_class")).alias("score"),
        )
    )


def trained(coded: DataFrame, model: Hmm, share: np.ndarray) -> Hmm:
    """One Baum-Welch round over all rows of ``coded`` (ids): expected counts by class and state, added up in tasks and over partitions."""
    k, classes = len(model.start), len(share)
    names = [f"z{z}" for z in range(k)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
        for batch in batches:
            for part in slices(batch, 4096, 1 << 18):
                ids = [np.frombuffer(x, np.uint16) for x in part.column(0).to_pylist()]
                a, b, c = model.expected([x[i : i + SEGMENT] for x in ids for i in range(0, len(x), SEGMENT)])
                starts += a
                steps += b
                emits += c
        seen = np.flatnonzero(emits.any(1))
        key = np.concatenate([[-1], -2 - np.arange(k), seen])
        values = np.concatenate([starts[None, :], steps, emits[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.ascontiguousarray(values[:, z])) for z in range(k))], names=["key", *names])

    sums = coded.mapInArrow(expect, "key long, " + ", ".join(f"{x} double" for x in names)).groupBy("key").agg(*[F.sum(x).alias(x) for x in names])
    table = sums.toArrow()  # a row for each class, state and the start
    key = table.column("key").to_numpy()
    values = np.stack([table.column(x).to_numpy() for x in names], axis=1) if len(key) else np.zeros((0, k))
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k))
    emits[key[key >= 0]] = values[key >= 0]
    steps[-2 - key[key <= -2]] = values[key <= -2]
    starts += values[key == -1].sum(0)
    return model.updated(starts, steps, emits, share)
