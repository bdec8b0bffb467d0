"""Paths that records name, found among the files that are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps up that are taken in one path at most; each is a rewrite of the text.
UPS = 8


def listing(spark: SparkSession, *folders: str) -> DataFrame:
    """``file`` (normal) and ``path`` (as Spark names it) of the files below folders; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders)).select("path")
    return found.select(normal(F.regexp_replace("path", "^[a-z0-9]+:/+", "/")).alias("file"), "path")


def normal(path: Column) -> Column:
    """Whole path with slashes, without empty and ``.`` steps, and each ``..`` taken with the step before it."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./|/)*", "/")
    p = F.regexp_replace(p, "^\\./|/\\.$", "")
    for _ in range(UPS):
        p = F.regexp_replace(p, "(^|/)(?!\\.\\.(?:/|$))[^/]+/\\.\\.(?:/|$)", "$1")
    return F.regexp_replace(p, "^(/\\.\\.)+(?=/|$)", "")


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^([A-Za-z]:)?[\\/]")


def resolve(named: DataFrame, files: DataFrame, path: str, roots: Sequence[str] = (), root_columns: Sequence[str] = ()) -> DataFrame:
    """``named`` with ``file``, the first of the places where its path may stand that is there, else null.

    An absolute path has one place; another has one below each of ``roots``, then below each of
    ``root_columns`` (of the row itself), in that order. ``files`` has a row for each ``file`` (normal). Places are
    rows, joined on the whole path; a null or empty path has none.
    """
    whole = [c for c in named.columns if c != "file"]
    raw = F.col(path)
    below = [F.concat_ws("/", r, raw) for r in (*(F.lit(r) for r in roots), *(F.when(F.col(c).isNotNull(), F.col(c)) for c in root_columns))]
    places = F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(is_absolute(raw), F.array(raw)).otherwise(F.array(*below) if below else F.array(raw))
    own = named.select(*whole, F.struct(raw.alias("path"), places.alias("places")).alias("_wanted"))
    spread = own.select("_wanted").distinct().select("_wanted", F.posexplode("_wanted.places").alias("_at", "_place")).withColumn("file", normal(F.col("_place")))
    hit = spread.join(files.select("file").distinct(), "file").groupBy("_wanted").agg(F.min_by("file", "_at").alias("file"))
    return own.join(hit, "_wanted", "left").select(*whole, "file")
