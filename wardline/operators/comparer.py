"""Two engines compared from end to end: record lines, the snapshots that they name, candidates, winners, statistics, digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import paths, records, snapshots
from . import engines

#: The record's member that names its truth.
NAMED = "$.cache_snapshot_path_before"


def compared(lines: DataFrame, documents: DataFrame, tolerances: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """A row for each truth of the snapshot that a record names: ``line``, ``bed``, ``field``, ``truth``, each engine's value, text, status and error, and ``winner``.

    ``lines``: ``line`` (unique) and ``doc`` of the records. ``documents``: ``path`` (normal, whole) and ``doc``, null where it is
    no JSON object; such snapshots are named in vain. ``tolerances``: ``vital`` and ``tol``; a field without one has 0.
    """
    named = lines.select("line", "doc", F.try_variant_get("doc", NAMED, "string").alias("_named"))
    found = paths.resolve(named.select("line", "_named"), documents.select(F.col("path").alias("file")), "_named", roots).where("file is not null").select("line", F.col("file").alias("path"))
    readable = documents.where(F.schema_of_variant("doc").startswith("OBJECT")).withColumn("snapshot_ts", F.lit(None).cast("timestamp"))
    truth = snapshots.truth(readable, keep_empty_beds=False).where("truth is not null and not isnan(truth)").select("path", "bed", F.col("vital").alias("field"), "truth")
    read = records.engine_candidates(records.cells(lines.select("line", "doc"))).select("line", "bed", "field", "easy", "tess")
    rows = found.join(truth, "path").join(read, ["line", "bed", "field"], "left").join(tolerances.select(F.col("vital").alias("field"), "tol"), "field", "left")
    member = lambda e, c: F.col(f"{e}.{c}").alias(f"{e}_{c}")
    own = rows.select("line", "bed", "field", "truth", F.coalesce("tol", F.lit(0.0)).alias("tol"), *[member(e, c) for e in ("easy", "tess") for c in ("value", "text")], *[F.coalesce(f"{e}.status", F.lit("missing")).alias(f"{e}_status") for e in ("easy", "tess")])
    return engines.compared(own)


def confusion(rows: DataFrame) -> DataFrame:
    """``engine`` and how often each digit of the truth was read as which, of readings with a value."""
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.when(F.col(f"{e}_value").isNotNull(), F.coalesce(F.col(f"{e}_text"), F.lit(""))).alias("read")) for e in ("easy", "tess")]))
    return engines.digit_confusion(rows.select("truth", both.alias("_e")).select("truth", "_e.*"), "truth", "read", "engine")


def _said(status: str, engine: str) -> Column:
    return F.when(F.col(f"{engine}_status") == status, "said")


def statistics(rows: DataFrame, digits: int = 6) -> DataFrame:
    """By field, and over all (``field`` null); see ``engines.summary``."""
    return engines.summary(rows.withColumns({f"{e}_text": _said("invalid", e) for e in ("easy", "tess")}), digits=digits)
