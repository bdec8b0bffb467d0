"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

Documents are inverted first: by group of feature buckets, which documents have which bucket how often. The
postings are shuffled by group; there the corpora's totals of each bucket meet them, the bucket's gain is
worked out from both, and each posting becomes its contribution, count times gain. Contributions are added
up by document. Gumbel noise by document makes the draw: the k greatest scores are a sample without
replacement in proportion to the weights.

Postings lie in blocks of one tile (some thousand documents) and one group of buckets, so their size is
bounded and no bucket, however common, makes a task larger than others: a group is spread over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import scratch
from .terms import Terms
from .tokenizing import slices

BUCKETS = 10_000
#: Buckets that are shuffled together.
GROUP = 50
#: Documents of a tile, and bytes of their texts, at most (one text may be longer).
TILE, TILE_BYTES = 4096, 12 << 20
#: Tiles whose blocks of a group share a salt, about.
TILES_A_SALT = 64
#: Scores in a coarse bin of the ranking.
COARSE = 1024


class _Tile:
    """Postings of the documents gathered so far."""

    def __init__(self, width: int, buckets: int):
        self.width, self.buckets = width, buckets
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        n_words, of_text, bucket = np.zeros(len(texts), np.int64), [], []
        for k, (terms, text) in enumerate(Terms(texts).runs(self.width)):
            if k == 0:
                n_words = np.bincount(text, minlength=len(texts))
            of_text.append(text)
            bucket.append(terms.crc32() % np.uint32(self.buckets))
        text = np.concatenate(of_text)
        key, count = np.unique((text + self.docs) * self.buckets + np.concatenate(bucket), return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.sizes.append(np.stack([n_words, np.bincount(text, minlength=len(texts))]))
        self.ids.append(ids)
        self.docs += len(texts)
        self.bytes += sum(map(len, texts))

    def rows(self, tile: int, schema: pa.Schema) -> pa.RecordBatch:
        """The tile's own row (group -1), and a row for each group of buckets that it has."""
        key, count = np.concatenate(self.keys), np.concatenate(self.counts)
        doc, bucket = np.divmod(key, self.buckets)
        order = np.argsort(bucket, kind="stable")
        doc, bucket, count = doc[order].astype("<u2"), bucket[order], count[order].astype("<u4")
        group, at = np.unique(bucket // GROUP, return_index=True)
        ends = [*at[1:].tolist(), len(bucket)]
        spans = list(zip(at.tolist(), ends, strict=True))
        within = (bucket % GROUP).astype(np.uint8)
        cut = lambda x: pa.array([None] + [x[a:b].tobytes() for a, b in spans], pa.binary())
        ids = pa.concat_arrays(self.ids)
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(spans) + 1), pa.int32()), ids)
        sizes = np.concatenate(self.sizes, axis=1).astype("<i8")
        own = pa.array([True] + [False] * len(spans))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([tile] * (len(spans) + 1), pa.int64()), pa.array([-1, *group.tolist()], pa.int32()),
                pa.compute.if_else(own, lists, pa.scalar(None, lists.type)), pa.array([sizes.tobytes()] + [None] * len(spans), pa.binary()), cut(within), cut(doc), cut(count),
            ],
            schema=schema,
        )


def postings(docs: DataFrame, width: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of inverted postings: ``tile``, ``group``, ``buckets`` (place in the group), ``docs`` (place in the tile) and ``counts``; and for each tile a row of group -1 with its ``ids`` and ``sizes`` (words, then features, of each).

    Tiles are numbered by the task that makes them, so this is to be written once and read back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    one = docs.schema[id_col].dataType
    schema = StructType([StructField("tile", LongType()), StructField("group", IntegerType()), StructField("ids", ArrayType(one)), *(StructField(c, BinaryType()) for c in ("sizes", "buckets", "docs", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        tile = _Tile(width, buckets)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                if tile.docs and (tile.docs + len(texts) > TILE or tile.bytes + sum(map(len, texts)) > TILE_BYTES):
                    yield tile.rows(number, shape)
                    number, tile = number + 1, _Tile(width, buckets)
                tile.add(part.column(0), texts)
        if tile.docs:
            yield tile.rows(number, shape)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def totals(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n`` of a corpus, added up in each task and then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + GROUP, np.int64)
        for batch in batches:
            for g, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[g * GROUP : (g + 1) * GROUP] += np.bincount(np.frombuffer(b, np.uint8), np.frombuffer(n, "<u4"), GROUP).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return blocks.where("group >= 0").select("group", "buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int = BUCKETS) -> Column:
    """Thousand times the log of the target's smoothed share over the corpus's, rounded down."""
    d = lambda c: c.cast("double")
    return F.floor(1000.0 * F.log((d(t) + 1) * (d(all_s) + float(buckets)) / ((d(s) + 1) * (d(all_t) + float(buckets))))).cast("long")


def weights(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_features`` and ``weight``, the sum of gains over its features."""
    spark = docs.sparkSession
    own = scratch.write(postings(docs, width, buckets, id_col, text_col), "postings")
    other = postings(target.select(F.lit(0).alias("_id"), F.col(target_text_col).alias("_text")), width, buckets, "_id", "_text")
    both = totals(own, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(totals(other, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    sums = scratch.write(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "totals")  # ``buckets`` rows
    whole = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    salts = max(1, own.where("group = -1").count() // TILES_A_SALT)
    # The corpora's totals of a group, beside each salt of its blocks.
    group = F.floor(F.col("bucket") / GROUP).cast("int")
    totals_of = sums.groupBy(group.alias("group")).agg(F.collect_list(F.struct((F.col("bucket") % GROUP).cast("int").alias("at"), "s", "t")).alias("of")).crossJoin(F.broadcast(whole))  # one row
    totals_of = totals_of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocks = own.where("group >= 0").select("tile", "group", "buckets", "docs", "counts", F.pmod(F.xxhash64("tile"), F.lit(salts)).cast("int").alias("salt"))
    met = blocks.join(totals_of.hint("shuffle_hash"), ["group", "salt"])
    gains = F.transform("of", lambda e: F.struct(e["at"].alias("at"), gain(e["s"], e["t"], F.col("all_s"), F.col("all_t"), buckets).alias("gain")))

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, d, n, g in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                worth = np.zeros(GROUP, np.int64)
                worth[[x["at"] for x in g]] = [x["gain"] for x in g]
                own = worth[np.frombuffer(b, np.uint8)] * np.frombuffer(n, "<u4").astype(np.int64)
                out.append(np.bincount(np.frombuffer(d, "<u2"), own).astype("<i8").tobytes())  # whole numbers under 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["tile", "part"])

    parts = met.select("tile", "buckets", "docs", "counts", gains.alias("gains")).mapInArrow(contribute, "tile long, part binary")
    tiles = own.where("group = -1").select("tile", "ids", "sizes", F.lit(None).cast("binary").alias("part"))
    rows = tiles.unionByName(parts, allowMissingColumns=True)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("weight", LongType())])

    def add_up(table: pa.Table) -> pa.Table:
        """One tile: its own row and at most as many parts as there are groups."""
        n = pa.compute.list_value_length(table.column("ids")).to_pylist()
        k = next(i for i, x in enumerate(n) if x is not None)
        weight = np.zeros(n[k], np.int64)
        for p in table.column("part").to_pylist():
            if p is not None:
                x = np.frombuffer(p, "<i8")
                weight[: len(x)] += x
        sizes = np.frombuffer(table.column("sizes")[k].as_py(), "<i8").reshape(2, -1)
        return pa.table([table.column("ids")[k].values, pa.array(sizes[0]), pa.array(sizes[1]), pa.array(weight)], names=schema.names)

    out = scratch.write(rows.groupBy("tile").applyInArrow(add_up, schema), "weights")
    scratch.release(spark, [p for df in (own, sums) for p in scratch.tables_of(df)])
    return out


def noise(seed: int, id_col: str) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, k: int, eligible: Column, id_col: str = "doc_id") -> DataFrame:
    """``scored`` (a written table) with ``rank`` of the k eligible rows of greatest ``score``, ties to smaller ids, null for the rest.

    Rows are counted by score; sums over coarse bins of scores, and over the scores of each bin, say how many
    rows are before a score; rows of one score are ranked among themselves.
    """
    names = [c for c in scored.columns if c != "rank"]
    coarse = F.floor(F.col("score") / COARSE)
    counts = scored.where(eligible).groupBy("score").agg(F.count("*").alias("_n")).withColumn("_bin", coarse)
    bins = counts.groupBy("_bin").agg(F.sum("_n").alias("_k"))
    bins = bins.select("_bin", (F.sum("_k").over(Window.orderBy(F.desc("_bin"))) - F.col("_k")).alias("_above")).where(F.col("_above") < k)  # a row for each 1024 scores
    within = F.sum("_n").over(Window.partitionBy("_bin").orderBy(F.desc("score"))) - F.col("_n")
    before = counts.join(bins, "_bin").select(F.col("score").alias("_score"), (F.col("_above") + within).alias("_before")).where(F.col("_before") < k)
    own = scored.where(eligible).join(before, F.col("score") == F.col("_score"))
    nth = F.row_number().over(Window.partitionBy("_score").orderBy(F.asc_nulls_last(id_col)))
    ranked = own.withColumn("rank", F.col("_before") + nth).select(*names, "rank")
    rest = scored.where(~eligible).union(scored.where(eligible).join(before, F.col("score") == F.col("_score"), "left_anti"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, width: int = 1, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_features``, ``weight``, ``score`` (with noise) and ``rank`` of those drawn.

    Features are all runs of 1 to ``width`` terms (see ``terms``). ``percent`` of the documents of
    ``least_words`` words and more are drawn, rounded down. Null and empty texts have no features and weight
    0. Rows repeated with their id have equal scores and ranks of their own; null ids come last among equal
    scores. Other columns are not read; an empty table gives no rows, an empty target leaves the smoothing.
    """
    found = weights(docs, target, width, buckets, id_col, text_col, target_text_col)
    scored = found.withColumn("score", F.col("weight") + noise(seed, id_col))
    eligible = F.col("n_words") >= least_words
    k = scored.where(eligible).count() * percent // 100
    return draw(scored, k, eligible, id_col)
