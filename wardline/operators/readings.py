"""Readings in sequence: prior values, holding the last one, scores of candidates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


#: Width of the parts that a key's order is cut into, where none is given: whole-number orders are dense ones (numbers of events or frames).
STEP = 100_000


def prior_confirmed(df: DataFrame, keys: list[str], order: str, value: str, name: str = "prior", step: int = STEP) -> DataFrame:
    """The last value before each row that is there. ``order`` is a number; parts of ``step`` of it are worked on side by side."""
    return scan.scan(df, keys, [order], step, **{name: scan.latest(F.col(value), upto=False)})


def hold_last(df: DataFrame, keys: list[str], order: str, value: str, exempt: Column | None = None, step: int = STEP) -> DataFrame:
    """``held`` (the value, or the prior one where there is none) and ``imputed``; rows that are ``exempt`` keep their null."""
    out = prior_confirmed(df, keys, order, value, "_prior", step)
    may = F.lit(True) if exempt is None else ~exempt
    fill = F.col(value).isNull() & F.col("_prior").isNotNull() & may
    return out.withColumns({"held": F.when(fill, F.col("_prior")).otherwise(F.col(value)), "imputed": fill}).drop("_prior")


def continuity_bonus(value: Column, prior: Column) -> Column:
    """What nearness to the prior value is worth."""
    apart = F.abs(value - prior) / F.greatest(F.abs(prior), F.lit(1.0))
    return F.when(value.isNull() | prior.isNull(), 0.0).when(apart <= 0.03, 0.25).when(apart <= 0.10, 0.15).when(apart <= 0.30, 0.05).otherwise(-0.10)


def candidate_score(confidence: Column, text: Column, well_formed: Column, value: Column, prior: Column) -> Column:
    return (
        1.5 * F.coalesce(confidence, F.lit(0.35))
        + F.when(well_formed, 0.8).otherwise(-0.4)
        + 0.08 * F.least(F.length(text), F.lit(4))
        + F.when(value.isNotNull(), 0.2).otherwise(-0.2)
        + continuity_bonus(value, prior)
    )


def best_scored(df: DataFrame, keys: list[str], score: str, place: str) -> DataFrame:
    """The candidate of the greatest score of each key, the first of equals: partial maxima, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(place))).alias("_b")).select(*keys, "_b.*")


def changes(df: DataFrame, keys: list[str], order: str, stamp: str, step: int = STEP) -> DataFrame:
    """Whether the stamp differs from the one before; the first of a key does."""
    before = scan.scan(df, keys, [order], step, _before=scan.latest(F.struct(F.col(stamp).alias("stamp")), upto=False))
    stood = F.col("_before.stamp")
    return before.withColumn("changed", ~F.col(stamp).eqNullSafe(stood) | stood.isNull()).drop("_before")


def islands(df: DataFrame, keys: list[str], index: str, weight: str | None = None, step: int = STEP) -> DataFrame:
    """Runs of consecutive indices: first, last, length and (weighted) centre."""
    weighed = F.col(weight) if weight else F.lit(1.0)
    numbered = scan.scan(df, keys, [index], step, _nth=scan.total(F.lit(1)))
    return numbered.withColumn("_run", F.col(index) - F.col("_nth")).groupBy(*keys, "_run").agg(
        F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count("*").alias("length"), F.round(F.try_divide(F.sum(F.col(index) * weighed), F.sum(weighed)), 6).alias("centre")
    ).drop("_run")


def capped(df: DataFrame, tick: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each tick (a feature of the report, not a limit of the join)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*tick).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def strictly_rising(df: DataFrame, keys: list[str], order: list[str], position: str, step: int = STEP) -> DataFrame:
    """``nth`` and ``fixed``: positions moved up as little as makes each exceed the one before it, a running maximum of what they are ahead of their rank. The first of ``order`` is a number."""
    ranked = scan.scan(df, keys, order, step, nth=scan.total(F.lit(1)))
    ahead = scan.scan(ranked, keys, order, step, _ahead=scan.most(F.col(position) - F.col("nth")))
    return ahead.withColumn("fixed", F.col("_ahead") + F.col("nth")).drop("_ahead")


def stale(ts: Column, now: Column, after_s: float) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, now) > F.lit(int(after_s * 1_000_000))
