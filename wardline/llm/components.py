"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Edges that a task holds before it reduces them to a forest, about.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the least it reaches over the edges, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while not np.array_equal(short := up[up], up):
            up = short
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[child], nodes[up[child]]


def _forest(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v, changed) reduced in each task: a node stands under the least node it reaches there, once. Nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, changed, held = [], [], False, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(v[0]), pa.array(np.full(len(u[0]), changed))], names=["u", "v", "changed"])

        for batch in batches:
            u.append(np.asarray(batch.column(0)))
            v.append(np.asarray(batch.column(1)))
            changed = changed or bool(np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).any())
            held += batch.num_rows
            if held > HELD:
                x, y = stars(np.concatenate(u), np.concatenate(v))
                u, v, held = [x], [y], len(x)
                if held > HELD // 2:
                    yield out()
                    u, v, held = [], [], 0
        if held:
            x, y = stars(np.concatenate(u), np.concatenate(v))
            u, v = [x], [y]
            yield out()

    return edges.mapInArrow(run, "u long, v long, changed boolean")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node of ``edges`` (u, v: long, not null).

    Each task first reduces its edges to a forest. Then, in rounds, a node's neighbours and the node
    are tied to the least of them, and tasks reduce again, until no edge changes. A round writes one
    table to the shared folder. A hot node is only joined on, never collected: in each task it is
    the parent of a node once. Loops count as single nodes. The result is such a table too, so that
    what is built on it has none of these steps in its plan.
    """
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    now = scratch.write(_forest(edges.where("u <> v").select("u", "v", F.lit(True).alias("changed"))), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), ((F.col("v") != F.col("m")) & (F.col("u") != F.col("m"))).alias("changed")
        )
        before, now = now, scratch.write(_forest(tied), "edges")
        scratch.release(now.sparkSession, scratch.tables_of(before))
        if not now.where("changed").limit(1).count():
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = found.union(now.select(F.col("v"), F.col("v"))).union(alone.join(now.select(F.col("u").alias("node")), "node", "left_anti")).distinct()
    found = scratch.write(found, "components")
    scratch.release(now.sparkSession, scratch.tables_of(now))
    return found
