"""Snapshots of the truth: JSON documents in a folder, one per moment, to long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_time, safe_float

#: Fixed: how files of snapshots are named.
NAME = r"(\d{8})_(\d{6})_(\d{3})_monitor_cache\.json$"
NAME_OR_BEFORE = r"^(\d{8})_(\d{6})_(\d{3})(?:_before)?_monitor_cache\.json$"


def prepare(spark: SparkSession) -> None:
    """JSON objects with a key twice are read as their last value, as the writers mean them."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def name_time(name: Column, pattern: str = NAME, zone: str = "+09:00") -> Column:
    part = lambda i: F.regexp_extract(name, pattern, i)
    d, t, ms = part(1), part(2), part(3)
    iso = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit("T"), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2), F.lit("."), ms)
    return F.when(d != "", iso_time(iso, zone))


def load(spark: SparkSession, folder: str, before: bool = False) -> DataFrame:
    """``path``, ``name``, ``snapshot_ts`` (of the name, else when the file was last changed) and ``doc``; documents that are no JSON object are left out. ``before`` reads the time of "before" names too."""
    prepare(spark)
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*_monitor_cache.json").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("changed"), F.try_parse_json("value").alias("doc"))
    return raw.where(F.schema_of_variant("doc").startswith("OBJECT")).select("path", "name", F.coalesce(name_time(F.col("name"), NAME_OR_BEFORE if before else NAME), F.col("changed")).alias("snapshot_ts"), "doc")


def current(spark: SparkSession, path: str, previous: DataFrame | None = None) -> DataFrame:
    """The cache as it is now; the previous one where it cannot be read as an object."""
    prepare(spark)
    now = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))
    return now if previous is None else now.select(F.lit(0).alias("p"), "doc").union(previous.select(F.lit(1), "doc")).orderBy("p").limit(1).select("doc")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def members(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each member of an object (one of nulls for any other value)."""
    tvf = df.sparkSession.tvf.variant_explode(F.col(column).outer()).select(F.col("key").alias(key), F.col("value").alias(value))
    return df.lateralJoin(tvf)


def truth(snapshots: DataFrame, keep_empty_beds: bool = True) -> DataFrame:
    """``path``, ``snapshot_ts``, ``bed``, ``vital``, ``truth``: members of a bed's ``vitals``, then fields directly under it that are objects with a ``value``, unless the vital is there already. Beds without either have one row without vital, or none."""
    beds = members(snapshots.withColumn("_beds", F.try_variant_get("doc", "$.beds", "variant")).where(is_object(F.col("_beds"))), "_beds", "bed", "_bed").where(is_object(F.col("_bed")))
    inner = beds.withColumn("_vitals", F.try_variant_get("_bed", "$.vitals", "variant"))
    value = F.when(is_object(F.col("_v")), F.try_variant_get("_v", "$.value", "string")).otherwise(F.try_variant_get("_v", "$", "string"))
    nested = members(inner.where(is_object(F.col("_vitals"))), "_vitals", "vital", "_v").select("path", "snapshot_ts", "bed", "vital", value.alias("raw"), F.lit(0).alias("p"))
    direct = members(beds, "_bed", "vital", "_v").where(~F.col("vital").isin("vitals", "values") & is_object(F.col("_v")) & F.schema_of_variant("_v").rlike(r"\bvalue:"))
    direct = direct.select("path", "snapshot_ts", "bed", "vital", F.try_variant_get("_v", "$.value", "string").alias("raw"), F.lit(1).alias("p"))
    rows = nested.unionByName(direct).where("vital is not null").groupBy("path", "snapshot_ts", "bed", "vital").agg(F.min_by("raw", "p").alias("raw"))
    if keep_empty_beds:
        rows = beds.select("path", "snapshot_ts", "bed").join(rows, ["path", "snapshot_ts", "bed"], "left")
    return rows.withColumn("truth", safe_float(F.col("raw"))).drop("raw")


def event_time(snapshots: DataFrame) -> DataFrame:
    """``path`` and ``event_ts``: the first time that parses of four fields, then of ``meta``, then of the first bed (by name) that has one."""
    own = [iso_time(F.try_variant_get("doc", f"$.{k}", "string")) for k in ("updated_at", "captured_at", "message_datetime", "timestamp", "meta.message_datetime")]
    beds = members(snapshots.withColumn("_beds", F.try_variant_get("doc", "$.beds", "variant")).where(is_object(F.col("_beds"))), "_beds", "bed", "_bed")
    of_bed = beds.select("path", "bed", iso_time(F.try_variant_get("_bed", "$.message_datetime", "string")).alias("t")).where("t is not null").groupBy("path").agg(F.min_by("t", "bed").alias("_bed_ts"))
    return snapshots.join(of_bed, "path", "left").select("path", F.coalesce(*own, F.col("_bed_ts")).alias("event_ts"))


def normal_path(path: Column) -> Column:
    """A path's last part, whichever system wrote it: what records and snapshots are joined on."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
