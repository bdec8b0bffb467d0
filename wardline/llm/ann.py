"""Approximate nearest neighbours by learned partitions.

1. A bounded sample gets its neighbour graph (each task searches for some of the sample).
2. The graph is cut into balanced parts, by halves: nodes are put in order by a smoothed vector over
   the graph, cut in the middle, and pairs are swapped while that saves edges.
3. A small network learns, from a vector, the parts that its neighbours are in.
4. Every vector goes to its most probable part. A query goes to several, most probable first, whose
   vectors are reranked by exact distance. Parts are split into salts of bounded size, so a part
   that holds a third of all vectors is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .labelled import thinned

#: Vectors that the graph, its parts and the network are fitted on at most.
SAMPLE = 8192
NEIGHBOURS = 10
#: Vectors a part is meant to hold, and parts at most.
PART_ROWS, MOST_PARTS = 512, 256
HIDDEN, EPOCHS = 128, 40
#: A query goes on to further parts until their probabilities add up to MASS, at LEAST of the parts.
MASS, LEAST = 0.995, 0.2
#: Vectors of a part in one salt.
SALT_ROWS = 8192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows that take part: id not null; vector not null, zero or empty, all components finite, and of the most frequent length (the least if several)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (size.d if size else 0))


def nearest_in(base: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``base`` nearest to each query (for the graph: in single precision)."""
    d = (base * base).sum(1)[None, :] - 2 * queries @ base.T
    return np.argpartition(d, min(k, len(base) - 1), axis=1)[:, : k + 1]


def halves(graph: list[np.ndarray], nodes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of ``nodes`` (to one) with few edges between them."""
    place = {x: i for i, x in enumerate(nodes.tolist())}
    edges = np.array([(i, place[y]) for i, x in enumerate(nodes.tolist()) for y in graph[x].tolist() if y in place], np.int64).reshape(-1, 2)
    n = len(nodes)
    degree = np.bincount(edges[:, 0], minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(60):
        x = 0.5 * x + 0.5 * (np.bincount(edges[:, 0], weights=x[edges[:, 1]], minlength=n) + x) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        other = np.bincount(edges[:, 0], weights=side[edges[:, 1]] != side[edges[:, 0]], minlength=n)
        gain = 2 * other - (degree - 1)
        a, b = (np.flatnonzero(side == s) for s in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 20))
        swap = gain[a[:m]] + gain[b[:m]] > 1
        if not swap.any():
            break
        side[a[:m][swap]], side[b[:m][swap]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(graph: list[np.ndarray], parts: int) -> np.ndarray:
    """A part (0 to parts - 1, a power of two) for each node; sizes differ by one at most."""
    rng = np.random.default_rng(5)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [h for g in groups for h in halves(graph, g, rng)]
    out = np.zeros(len(graph), np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


@dataclass
class Router:
    """Vector to probabilities of parts: one hidden layer, on vectors shifted and scaled as the sample's."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        x = np.clip((v - self.shift) / self.scale, -1e6, 1e6)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @staticmethod
    def fit(v: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Router:
        """Cross-entropy against the share of a vector's neighbours in each part, by Adam."""
        rng = np.random.default_rng(3)
        n, d = v.shape
        shift = v.mean(0)
        scale = float(np.sqrt(((v - shift) ** 2).mean())) or 1.0
        p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
        first, second, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
        x_all = (v - shift) / scale
        for epoch in range(epochs):
            for own in np.array_split(rng.permutation(n), max(1, n // 256)):
                x = x_all[own]
                h = np.maximum(x @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                e = (z / z.sum(1, keepdims=True) - target[own]) / len(own)
                back = (e @ p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    p[i] -= 3e-3 * 0.93**epoch * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return Router(shift, scale, *p)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1 if len(column) else 0)


def fit(rows: DataFrame, total: int) -> Router | None:
    """The router for ``total`` vectors; none if one part holds them all."""
    parts = 1 << int(np.log2(max(1, min(MOST_PARTS, total / PART_ROWS))))
    if parts < 4:
        return None
    sample = thinned(rows, SAMPLE, "id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()  # SAMPLE rows at most
    v = matrix(sample.column("v").combine_chunks())
    single = v.astype(np.float32)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(single)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            at = np.asarray(batch.column(0))
            near = [nearest_in(base, base[at[i : i + 256]], NEIGHBOURS) for i in range(0, len(at), 256)]
            near = np.concatenate(near) if near else np.zeros((0, NEIGHBOURS + 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["node", "near"])

    found = spark.range(0, len(v), 1, min(64, max(1, len(v) // 512))).mapInArrow(search, "node long, near array<long>").collect()  # SAMPLE rows at most
    near = [np.empty(0, np.int64)] * len(v)
    for r in found:
        near[r.node] = np.array([y for y in r.near if y != r.node][:NEIGHBOURS], np.int64)
    both = [set(x.tolist()) for x in near]
    for x, ys in enumerate(near):
        for y in ys.tolist():
            both[y].add(x)
    part = balanced_parts([np.array(sorted(s), np.int64) for s in both], parts)
    target = np.zeros((len(v), parts))
    for x, ys in enumerate(near):
        np.add.at(target[x], part[ys], 1.0)
        target[x, part[x]] += 1
    return Router.fit(v, target / target.sum(1, keepdims=True))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, mass: float = MASS, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per query: ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance, double) of its ``k`` nearest found, ties to the smaller id.

    Vectors (and queries) that are null, zero, empty, hold null or non-finite components, are not of
    the usual length or have a null id take no part. A row is never its own query's neighbour (same id). Rows
    repeated under an id are candidates each; a query given more than once is asked once (its least
    vector). All candidates are returned where there are fewer than ``k``; no usable vectors, no rows.
    """
    rows = scratch.write(usable(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    if total == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = rows.select(F.size("v").alias("d")).first().d
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = usable(asked, "id", "v").where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))
    router = fit(rows, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.probabilities(matrix(batch.column(1))).argmax(1) if router is not None else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    v_type = rows.schema["v"].dataType.simpleString()
    placed = scratch.write(rows.mapInArrow(place, f"id long, v {v_type}, part int"), "placed")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    parts = len(router.b2) if router is not None else 1
    held = np.array([sizes.get(p, 0) for p in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = router.probabilities(matrix(batch.column(1))) if router is not None else np.ones((batch.num_rows, 1))
            order = np.argsort(-p, axis=1, kind="stable")
            sorted_p = np.take_along_axis(p, order, 1)
            before = np.cumsum(sorted_p, axis=1) - sorted_p
            rows_before = np.cumsum(held[order], axis=1) - held[order]
            wanted = (before < mass) | (np.arange(parts)[None, :] < least * parts) | (rows_before < 20 * k)
            row, at = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(order[row, at].astype(np.int32))], names=["id", "v", "part"])

    salts = F.greatest(F.lit(1), F.ceil(F.element_at(F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, n)]), F.col("part")) / SALT_ROWS)).cast("int")
    base = placed.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).withColumn("side", F.lit(0))
    routed = asked.mapInArrow(route, f"id long, v {v_type}, part int").where(F.col("part").isin(list(sizes)))
    routed = routed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("side", F.lit(1))
    both = base.unionByName(routed).select("part", "salt", "side", "id", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, stored = None, [], []
        held_ids = held_v = None
        for batch in batches:
            p, s, side, own = (np.asarray(batch.column(c)) for c in range(4))
            v = matrix(batch.column(4))
            cuts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]) | (side[1:] != side[:-1])])) if len(p) else np.empty(0, np.int64)
            out: list[list] = [[], [], []]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)], strict=True):
                if (p[a], s[a]) != key:
                    key, ids, stored, held_ids = (p[a], s[a]), [], [], None
                if side[a] == 0:
                    ids.append(own[a:b])
                    stored.append(v[a:b])
                    held_ids = None
                    continue
                if held_ids is None:
                    held_ids, held_v = (np.concatenate(ids), np.concatenate(stored)) if ids else (np.empty(0, np.int64), np.zeros((0, v.shape[1])))
                for q in range(a, b):
                    d = np.sqrt(((held_v - v[q]) ** 2).sum(1))
                    d[held_ids == own[q]] = np.inf
                    if len(d) > 4 * k:
                        edge = np.partition(d, k - 1)[k - 1]
                        few = np.flatnonzero(d <= edge)
                    else:
                        few = np.arange(len(d))
                    few = few[np.lexsort((held_ids[few], d[few]))][:k]
                    few = few[held_ids[few] != own[q]]
                    out[0] += [own[q]] * len(few)
                    out[1] += held_ids[few].tolist()
                    out[2] += d[few].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = both.repartition("part", "salt").sortWithinPartitions("part", "salt", "side").mapInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
