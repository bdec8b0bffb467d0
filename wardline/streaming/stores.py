"""Tables that a stream keeps, batch by batch, so that a batch sent again or a crash changes nothing.

What a batch writes goes beside what is there; a small manifest named by the batch, moved into its place last,
makes it count. Readers follow manifests alone. A batch that has a manifest is done and is passed over; one
that died before its manifest left files that nobody reads, and is done anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.latest import latest
from .state import each_batch

#: Parts of a latest store; a batch writes only those that its keys fall into.
BUCKETS = 64


class Manifests:
    """Manifests of a folder that Spark's file systems reach: ``<root>/manifests/<batch>.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches that count, in order."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, batch: int) -> dict:
        fs = self._fs()
        path = self._path("manifests", f"{batch:020d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readNBytes(int(fs.getFileStatus(path).getLen()))).decode())
        finally:
            stream.close()

    def put(self, batch: int, content: dict) -> None:
        """Written whole under another name first; the move fails where the batch has a manifest already."""
        fs = self._fs()
        beside, place = self._path("manifests", f".{batch:020d}.{uuid.uuid4().hex}"), self._path("manifests", f"{batch:020d}.json")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not fs.rename(beside, place):
            fs.delete(beside, False)
            raise RuntimeError(f"batch {batch} has a manifest already, or it could not be moved")

    def remove(self, *parts: str) -> None:
        self._fs().delete(self._path(*parts), True)

    def folders(self, name: str) -> list[str]:
        fs, folder = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


class LatestStore:
    """The latest row of each key in order of arrival, kept across batches.

    Keys fall into buckets by hash. A batch merges its rows with those buckets' rows and writes the buckets
    anew; its manifest names the folder of every bucket.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sequence: str, buckets: int = BUCKETS):
        self.manifests, self.keys, self.sequence, self.buckets = Manifests(spark, root), list(keys), sequence, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _rows(self, paths: dict[str, str], schema: StructType) -> DataFrame:
        spark, root = self.manifests.spark, self.manifests.root
        found = [f"{root}/{p}" for p in paths.values()]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether the batch was merged: one that is not newer than the last that counts is passed over."""
        done = self.manifests.batches()
        if done and batch_id <= done[-1]:
            return False
        before = self.manifests.read(done[-1]) if done else {"buckets": {}, "schema": batch.schema.jsonValue()}
        schema = StructType.fromJson(before["schema"])
        own = self._bucketed(batch.select(*schema.names))
        touched = [str(r[0]) for r in own.select("_bucket").distinct().collect()]  # at most ``buckets`` rows
        old = self._rows({b: p for b, p in before["buckets"].items() if b in touched}, schema)
        seen = self._bucketed(old.unionByName(own.drop("_bucket"))).withColumn("_at", F.col(self.sequence))
        merged = latest(seen, self.keys, "_at").select(*schema.names, "_bucket")
        folder = f"data/{batch_id:020d}-{uuid.uuid4().hex}"
        merged.write.partitionBy("_bucket").parquet(f"{self.manifests.root}/{folder}")
        now = before["buckets"] | {b: f"{folder}/_bucket={b}" for b in touched}
        self.manifests.put(batch_id, {"buckets": now, "schema": before["schema"]})
        return True

    def read(self, as_of: int | None = None) -> DataFrame | None:
        """The rows after the last batch, or after the last one up to ``as_of``; None before any."""
        done = [b for b in self.manifests.batches() if as_of is None or b <= as_of]
        if not done:
            return None
        found = self.manifests.read(done[-1])
        return self._rows(found["buckets"], StructType.fromJson(found["schema"]))

    def tidy(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` manifests, and the folders that no manifest left names (those of dead batches too); not while a batch is written."""
        done = self.manifests.batches()
        for b in done[:-keep]:
            self.manifests.remove("manifests", f"{b:020d}.json")
        used = {p.split("/")[1] for b in done[-keep:] for p in self.manifests.read(b)["buckets"].values()}
        gone = [f for f in self.manifests.folders("data") if f not in used]
        for f in gone:
            self.manifests.remove("data", f)
        return gone

    def keep(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Merge every batch of a stream."""
        return each_batch(stream, lambda df, k: self.merge(df, k), checkpoint, once=once)


class Quarantine:
    """Good rows and bad ones of each batch, written together and counted under one batch.

    A bad row keeps its raw bytes and why it is bad; a good row keeps what was made of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.manifests = Manifests(spark, root)

    def put(self, batch: DataFrame, batch_id: int, reason: Column, raw: Column) -> bool:
        """``reason`` is null for a good row. One job writes both sides. False for a batch that counts already."""
        if batch_id in self.manifests.batches():
            return False
        sided = batch.withColumns({"_reason": reason, "_raw": raw.cast("binary")})
        sided = sided.withColumns({"_side": F.when(F.col("_reason").isNull(), "good").otherwise("bad"), "_raw": F.when(F.col("_reason").isNotNull(), F.col("_raw"))})
        folder = f"data/{batch_id:020d}-{uuid.uuid4().hex}"
        sided.write.partitionBy("_side").parquet(f"{self.manifests.root}/{folder}")
        self.manifests.put(batch_id, {"folder": folder, "schema": sided.drop("_side").schema.jsonValue()})
        return True

    def _side(self, side: str) -> DataFrame | None:
        found = [self.manifests.read(b) for b in self.manifests.batches()]
        if not found:
            return None
        schema = StructType.fromJson(found[0]["schema"])
        paths = [f"{self.manifests.root}/{f['folder']}/_side={side}" for f in found if f"_side={side}" in self.manifests.folders(f["folder"])]
        spark = self.manifests.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def good(self) -> DataFrame | None:
        rows = self._side("good")
        return None if rows is None else rows.drop("_reason", "_raw")

    def bad(self) -> DataFrame | None:
        """``_reason`` and ``_raw``, with what else is known."""
        return self._side("bad")

    def keep(self, stream: DataFrame, reason: Column, raw: Column, checkpoint: str, once: bool = False) -> StreamingQuery:
        return each_batch(stream, lambda df, k: self.put(df, k, reason, raw), checkpoint, once=once)

