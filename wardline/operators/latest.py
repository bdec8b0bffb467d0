"""Latest state by key, in order of arrival: partial maxima before the shuffle, no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def latest(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of each key that came last, whole. Works on streams (complete or update mode) too."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")).select(*keys, "_last.*")


def running_missing(df: DataFrame, field: str, value: str) -> DataFrame:
    """Readings and missing readings of each field so far."""
    return df.groupBy(field).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"))


def running_missing_at(df: DataFrame, field: str, frame: str, value: str, step: int) -> DataFrame:
    """For each field and frame (a number): readings and missing readings in it, and those of all frames so far. Frames are ``step`` to a part (see ``scan``)."""
    counts = df.groupBy(field, frame).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"))
    return scan.scan(counts, [field], [frame], step, n_so_far=scan.total(F.col("n")), missing_so_far=scan.total(F.col("missing")))


def bed_key(bed: str = "bed_id", *others: str, default: str = "UNASSIGNED"):
    """First of the columns that is not empty, else the default."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (bed, *others)], F.lit(default))


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small table, marked to be broadcast if it has at most so many rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def flagged_or_first(df: DataFrame, keys: list[str], flag: Column, order: list[str]) -> DataFrame:
    """The first flagged row of each key, or the first of all where none is: partial minima, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(~F.coalesce(flag, F.lit(False)), *order)).alias("_b")).select(*keys, "_b.*")
