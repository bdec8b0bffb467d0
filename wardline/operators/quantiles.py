"""Exact quantiles of groups whose values never meet in one task.

Equal values are counted first, in tasks and then over them. Counts are added up in bins of a fixed
scale, 256 to each power of two; the bins' running sums say which bin holds a wanted rank, and only the
values of that bin are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(x: Column) -> Column:
    """A number that never falls where ``x`` rises; not-a-number is greatest."""
    size = F.floor(F.greatest(F.lit(-1100.0), F.least(F.log2(F.abs(x)), F.lit(1100.0))) * 256) + (1 << 20)
    return F.when(F.isnan(x), F.lit(1 << 24).cast("long")).when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and a column for each of ``wanted`` (name: share from 0 to 1), with linear interpolation between ranks. Nulls count for nothing; a group of nulls alone has no row, nor has an empty table."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(group.alias("_g"), x.alias("_x")).agg(F.count("*").alias("_c")).withColumn("_bin", _bin(F.col("_x")))
    bins = counts.groupBy("_g", "_bin").agg(F.sum("_c").alias("_k"))
    upto = bins.withColumns({"_upto": F.sum("_k").over(Window.partitionBy("_g").orderBy("_bin")), "_n": F.sum("_k").over(Window.partitionBy("_g"))})
    at = [F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for name, q in wanted.items()]
    asked = upto.withColumn("_w", F.explode(F.array(*at))).withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_w.at"), F.ceil("_w.at")))))
    asked = asked.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_k"))).select("_g", "_bin", "_w", "_r", (F.col("_upto") - F.col("_k")).alias("_below"))
    own = counts.join(asked, ["_g", "_bin"]).withColumn("_end", F.col("_below") + F.sum("_c").over(Window.partitionBy("_g", "_w", "_r").orderBy("_x")))
    hit = own.where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c")))

    def quantile(name: str) -> Column:
        mine = F.col("_w.name") == name
        low, high = (F.max(F.when(mine & (F.col("_r") == end(F.col("_w.at"))), F.col("_x"))) for end in (F.floor, F.ceil))
        part = F.max(F.when(mine, F.col("_w.at") - F.floor(F.col("_w.at"))))
        return F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name)

    return hit.groupBy("_g").agg(*[quantile(name) for name in wanted]).select(*[F.col(f"_g.{c}").alias(c) for c in by], *wanted)


def with_quantiles(stats: DataFrame, df: DataFrame, value: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``stats`` (a row a group) with the quantiles of ``df``'s groups, null where a group has none."""
    found = quantiles(df, value, wanted, by)
    if not by:
        return stats.join(F.broadcast(found), F.lit(True), "left")  # one row
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return stats.join(found.select(*[F.col(c).alias(f"_q_{c}") for c in by], *wanted), same, "left").drop(*[f"_q_{c}" for c in by])
