"""Tables that cut lineage, kept in the folder the cluster shares between driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written and not released. Operators release those that nothing they return reads; the pipeline, whose stages are written and reread, the others.
_written: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a new temporary folder set for a local session, and an error on a cluster, whose executors would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that later stages neither recompute it nor depend on executors that made it."""
    spark = df.sparkSession
    path = f"{root(spark)}/wardline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    return list(_written)


def tables_of(df: DataFrame) -> list[str]:
    """The tables written here that ``df`` reads."""
    read = df.inputFiles()
    return [p for p in _written if any(f"/{p.rpartition('/')[2]}/" in f for f in read)]


def release(spark: SparkSession, paths: list[str], needed_by: DataFrame | None = None) -> None:
    """Delete tables written here, but for those that ``needed_by`` reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    read = needed_by.inputFiles() if needed_by is not None else []
    for path in paths:
        name = path.rpartition("/")[2]
        if path in _written and not any(f"/{name}/" in f for f in read):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _written.remove(path)
