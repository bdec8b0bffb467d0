"""Near-duplicates by a join of MinHash signatures on their coordinates.

1. Documents with equal shingle sets are one class from the start, so copies cost one row each.
2. A class is posted under each (coordinate, value) pair of its signature. A link needs ``matches``
   equal coordinates, so two linked classes share a posting among the ``coordinates - matches + 1``
   rarest of each (prefix filter, postings in order of their number of classes). Values that one
   class alone has can never be shared: they fill the prefix first and are skipped.
3. Each class is held against one other first: of the least classes of its prefix postings the one it
   shares most of them with. Collisions are counted over all coordinates, and pairs over the threshold
   are confirmed on their full shingle sets, and confirmed links joined into components. Postings that
   lie within one component are skipped from here on: in a group of near copies, nearly all of them.
4. The other postings, joined where they share their least class, make clusters. A cluster's classes
   outside its largest component meet all of its classes in blocks of bounded size and bytes.
   Collisions are counted coordinate by coordinate; a pair is skipped once it cannot reach the
   threshold any more, or if it is connected already. Pairs over the threshold are confirmed in the
   block, by counting shared shingles in the block's own postings. A block gives a forest, never its
   pairs.
5. Components of all confirmed links, and the smallest id in each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import scratch
from .components import connected_components
from .textbytes import mix, shingles
from .tokenizing import give_back, slices

COORDINATES = 64
#: Of 64 coordinates, a pair of similarity 0.85 matches in fewer than this many with probability 2.4e-6; a more alike pair, less often.
MATCHES = 40
#: Classes, and shingles of theirs, that meet in one block, from each side, about.
BLOCK, BLOCK_SHINGLES = 2000, 4_000_000
#: Bytes of text that a task has in arrays of words at once, about: these take some thirty times as much.
AT_ONCE = 2 << 20
#: Classes whose texts are found by a broadcast of their keys at most; more are found by a shuffle.
FEW = 500_000
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, coordinates: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``thash`` (of its text), ``k1`` and ``k2`` (of its shingle set), ``n`` (the set's size), ``sig``."""
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("thash", LongType()), StructField("k1", LongType()), StructField("k2", LongType()),
        StructField("n", LongType()), StructField("sig", ArrayType(IntegerType())),
    ])
    a = _MULTIPLIERS[None, :coordinates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes=AT_ONCE):
                sets = shingles([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()], width)
                sig = np.zeros((len(sets), coordinates), np.uint64)
                k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i, x in enumerate(sets):
                    if len(x):
                        k1[i], k2[i] = mix(x).sum(), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum()
                        least = sig[i]
                        least[:] = np.iinfo(np.uint64).max
                        for at in range(0, len(x), 512):  # stays in the processor's cache
                            np.minimum(least, (x[at : at + 512, None] * a).min(0), out=least)
                flat = pa.array((sig >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel(), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.array([len(x) for x in sets], np.int64)), lists],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("thash"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def prefix_postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``node``, ``p`` and ``hub`` (the least node under ``p``) of prefix postings that hold more than one class."""
    prefix = coordinates - matches + 1
    postings = classes.select("node", F.posexplode("sig").alias("c", "v")).select(
        "node", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")).alias("p")
    )
    often = postings.groupBy("p").agg(F.count("*").alias("often")).where("often > 1")
    shared = postings.join(often, "p")
    # Values of one class alone come first in its prefix: it keeps as many of its shared ones as are left, rarest first.
    kept = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "p"))).alias("s"))  # at most ``coordinates`` a node
    kept = kept.select("node", F.explode(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - (coordinates - prefix)))).alias("e")).select("node", F.col("e.p").alias("p"))
    kept = scratch.write(kept, "prefixes")
    hubs = kept.groupBy("p").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("p", "hub")
    return kept.join(hubs, "p").select("node", "p", "hub")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|, of sorted arrays without repeats."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signature_matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1 if rows else 0)


def colliding(pairs: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """``pairs`` (u, v) whose signatures collide in ``matches`` coordinates and whose sets are near enough in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (signature_matrix(batch.column(k), batch.num_rows) for k in (2, 4))
            n, m = (np.asarray(batch.column(k)) for k in (3, 5))
            ok = ((x == y).sum(1) >= matches) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["u", "v"])

    of = lambda x: classes.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_sig"), F.col("n").alias(f"{x}_n"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_sig", "u_n", "v_sig", "v_n")
    return both.mapInArrow(run, "u long, v long")


def shingles_by_parts(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """``shingles`` of many texts, AT_ONCE bytes of them at a time."""
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end] or b"") <= AT_ONCE):
            total += len(texts[end] or b"")
            end += 1
        yield from shingles(texts[start:end], width)
        start = end


class Postings:
    """How many members each of many sets shares with a given one."""

    def __init__(self, sets: Iterable[np.ndarray]):
        sets = list(sets)
        self.sets = len(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        del sets
        by = np.argsort(value)
        self.owner = owner[by]
        del owner
        value = value[by]
        del by
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
        self.value, self.start = value[first], np.append(first, len(value))

    def shared(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.value, x)
        at[at == len(self.value)] = 0
        at = at[self.value[at] == x] if len(self.value) else at[:0]
        size = self.start[at + 1] - self.start[at]
        place = np.arange(size.sum()) + np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else at
        return np.bincount(self.owner[place], minlength=self.sets)


def block_links(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], x_texts: list[bytes], y_texts: list[bytes], matches: int, percent: int, width: int) -> list[tuple[int, int]]:
    """Links between rows of ``x`` and rows of ``y`` (each: nodes, components, sizes, signatures, whether outside the largest component) that join what was not joined before."""
    (n1, c1, s1, sig1, _), (n2, c2, s2, sig2, outside) = x, y
    coordinates = sig1.shape[1]
    half = coordinates // 2
    components, local = np.unique(np.concatenate([c1, c2]), return_inverse=True)
    label, l1, l2 = np.arange(len(components)), local[: len(c1)], local[len(c1) :]
    postings, found = Postings(shingles_by_parts(y_texts, width)), []
    for i, own in enumerate(shingles_by_parts(x_texts, width)):
        # Rows outside stand on both sides: their pairs are looked at once.
        able = (label[l2] != label[l1[i]]) & (~outside | (n1[i] < n2)) & (100 * np.minimum(s1[i], s2) >= percent * np.maximum(s1[i], s2))
        at = np.flatnonzero(able)
        count = (sig2[at, :half] == sig1[i, :half]).sum(1)
        at, count = at[count >= matches - (coordinates - half)], count[count >= matches - (coordinates - half)]
        at = at[count + (sig2[at, half:] == sig1[i, half:]).sum(1) >= matches]
        if len(at) == 0:
            continue
        both = postings.shared(own)[at]
        for j in at[100 * both >= percent * (len(own) + s2[at] - both)].tolist():
            p, q = label[l1[i]], label[l2[j]]
            if p != q:
                label[label == q] = p
                found.append((max(n1[i], n2[j]), min(n1[i], n2[j])))
    return found


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``_text`` (of one of its documents) of classes."""
    wanted = scratch.write(nodes.join(classes.select("node", "doc", "thash"), "node"), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    whole = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_thash"))
    texts = whole.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("thash") == F.col("_thash"))).groupBy("node").agg(F.first("_text").alias("_text"))
    return scratch.write(texts, "texts")


def cluster_links(postings: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, matches: int, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v), a forest for each block, between classes that share a prefix posting and are in different ``components`` (node, root)."""
    placed = postings.join(components, "node", "left").select("p", "node", "hub", F.coalesce("root", "node").alias("c"))
    open_ = placed.groupBy("p").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("p")
    # A class is tied to the least of its hubs, and its other hubs to that one: nearly an edge a class, as classes have few different hubs.
    hubs = placed.join(open_, "p").groupBy("node").agg(F.collect_set("hub").alias("hs")).withColumn("least", F.array_min("hs"))  # at most ``coordinates`` a class
    others = hubs.where(F.size("hs") > 1).select(F.explode("hs").alias("u"), F.col("least").alias("v")).distinct()
    clusters = connected_components(hubs.select(F.col("node").alias("u"), F.col("least").alias("v")).union(others).where("u <> v")).withColumnRenamed("root", "cluster")
    members = clusters.join(components, "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("c")).join(classes.select("node", "n", "sig"), "node")
    members = scratch.write(members, "members")
    by_component = members.groupBy("cluster", "c").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    weight = lambda k, s: F.ceil(F.greatest(k / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = by_component.groupBy("cluster").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.max(F.struct("k", "s", "c")).alias("home")).where("k > home.k")
    sizes = sizes.select("cluster", F.col("home.c").alias("home"), weight(F.col("k") - F.col("home.k"), F.col("s") - F.col("home.s")).alias("xs"), weight(F.col("k"), F.col("s")).alias("ys"))
    inside = members.join(sizes, "cluster").join(texts_of(members.select("node"), classes, docs, id_col, text_col), "node").withColumn("outside", F.col("c") != F.col("home"))
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    other = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rest = ["node", "c", "n", "sig", "outside", "_text"]
    left = inside.where("outside").select("cluster", part("xs").alias("x"), other("ys").alias("y"), F.lit(0).alias("side"), *rest)
    right = inside.select("cluster", other("xs").alias("x"), part("ys").alias("y"), F.lit(1).alias("side"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def block() -> pa.RecordBatch:
            found = []
            if held[0] and held[1]:
                x, y = (tuple(np.concatenate([r[k] for r in side]) for k in range(5)) for side in held)
                found = block_links(x, y, *([t for r in side for t in r[5]] for side in held), matches, percent, width)
                give_back()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            row = (*(np.asarray(batch.column(i)) for i in (4, 5, 6)), signature_matrix(batch.column(7), batch.num_rows), batch.column(8).to_numpy(zero_copy_only=False).astype(bool))
            texts = batch.column(9).cast(pa.binary()).to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(k)], strict=True):
                if tuple(k[a, :3]) != key:
                    yield block()
                    key, held = tuple(k[a, :3]), ([], [])
                held[int(k[a, 3])].append((*(c[a:b].copy() for c in row), texts[a:b]))
        yield block()

    keys = ["cluster", "x", "y"]
    return left.union(right).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``pairs`` (u, v) whose full shingle sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes=AT_ONCE):
                u, v = (part.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
                one = list(dict.fromkeys(v))  # a class that many are held against stands in one row after the other
                of = dict(zip(one, shingles(one, width), strict=True))
                ok = pa.array([linked(x, of[y], percent) for x, y in zip(shingles(u, width), v, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(ok) for k in (0, 1)], names=["u", "v"])

    pairs = scratch.write(pairs, "pairs")
    texts = texts_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), classes, docs, id_col, text_col)
    of = lambda x: texts.select(F.col("node").alias(x), F.col("_text").alias(f"{x}_text"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text", with_group: bool = False
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id it reaches over links) and ``kept`` (id = component_id).

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles. Null texts, empty texts and texts without words have no shingles and are
    linked with nothing: each is its own component, and kept. Rows repeated under one id share its
    component and are kept alike; a null id never stands for a component unless all of it is null,
    and then ``kept`` is true. ``with_group`` adds ``group`` (a number of the component itself, null
    without shingles; two components may have one least id where ids repeat) and ``text_hash`` (xxhash64 of the text). An empty table gives no rows. Other columns are not read.
    """
    own = scratch.write(signatures(docs, coordinates, width, id_col, text_col), "signatures")
    sets = own.where("n > 0")
    classes = sets.groupBy("k1", "k2").agg(F.min(F.struct(F.col(id_col).alias("doc"), "thash", "n", "sig")).alias("rep"), F.min(id_col).alias("least"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "least", F.col("rep.doc").alias("doc"), F.col("rep.thash").alias("thash"), F.col("rep.n").alias("n"), F.col("rep.sig").alias("sig"))
    classes = scratch.write(classes, "classes")

    postings = scratch.write(prefix_postings(classes, coordinates, matches), "postings")
    # One pair a class: with the least class that it shares most prefix postings with.
    hubs = postings.where("node <> hub").groupBy(F.col("node").alias("u")).agg(F.mode("hub", True).alias("v"))
    first = connected_components(confirmed(colliding(hubs, classes, matches, percent), classes, docs, percent, width, id_col, text_col))
    second = cluster_links(postings, first, classes, docs, matches, percent, width, id_col, text_col)
    roots = connected_components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(second))

    inside = classes.select("node", "least").join(roots, "node")
    of_root = inside.groupBy("root").agg(F.min("least").alias("of_root"))
    named = inside.join(of_root, "root").select("node", "root", "of_root")
    of_class = classes.select("node", "k1", "k2", "least").join(named, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("group"), F.coalesce("of_root", "least").alias("component_id"))
    of_class = scratch.write(of_class, "groups")
    found = own.drop("sig").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col))
    more = ["group", F.col("thash").alias("text_hash")] if with_group else []
    return found.select(id_col, F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"), *more)
