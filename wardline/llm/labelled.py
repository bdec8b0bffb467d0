"""A bounded sample of labelled rows, small enough to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def thinned(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About a tenth more than ``most`` of the rows, by hash of the key; all of them where they are not more. What picks the least by hash then never gathers more than that."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key, F.lit("thin")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.1 * most / n + 100 / n)))


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``_id`` and ``y`` (0 or 1) of labelled rows; ids labelled twice count as their greater label, null ids and labels are left out."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def picked(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of labelled rows (``_id``, ``y``), the ones least by hash."""
    return thinned(rows, most, "_id").orderBy(F.xxhash64("_id"), "_id").limit(most)


def sample(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids with ``y``."""
    return picked(labelled(labels, label_col, id_col), most)


def with_labels(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``text`` and ``y`` of the sampled documents; the sample is broadcast, so no text moves."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sampled), "_id")
