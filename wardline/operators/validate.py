"""Observations against truth: candidates, choice, match measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mismatch_tolerance
from .latest import few
from .quantiles import with_quantiles


def with_tolerance(df: DataFrame, tolerances: DataFrame, vital: str = "vital") -> DataFrame:
    """``tol`` of exactly the vital's name, else 0. The table has a row per vital name."""
    return df.join(few(tolerances.select(F.col("vital").alias("_v"), "tol")), F.col(vital) == F.col("_v"), "left").drop("_v").withColumn("tol", F.coalesce("tol", F.lit(0.0)))


def compare(df: DataFrame, observed: str = "observed", truth: str = "truth", scored: Column | None = None) -> DataFrame:
    """Adds ``abs_error`` (null if either is), ``match`` (within ``tol``, and scored) and ``mismatch`` (beyond the display tolerance)."""
    error = F.abs(F.col(observed) - F.col(truth))
    in_scope = F.lit(True) if scored is None else scored
    detail = F.coalesce((error > mismatch_tolerance(F.col("vital"), F.col(observed), F.col(truth))) & ~F.isnan(error), F.lit(False))
    return df.withColumns({"abs_error": error, "match": F.coalesce(error <= F.col("tol"), F.lit(False)) & in_scope, "mismatch": detail})


def best_candidate(pairs: DataFrame, record: list[str], candidate: list[str], delta: str, newest: str) -> DataFrame:
    """Per record the candidate with most matches, then least mean error (none counts as infinite), then least delta, then newest; with ``total``, ``matched``, ``mae``."""
    scored = pairs.groupBy(*record, *candidate).agg(
        F.count("*").alias("total"), F.count_if("match").alias("matched"), F.avg("abs_error").alias("mae"), F.min(delta).alias(delta), F.max(newest).alias(newest)
    )
    w = Window.partitionBy(*record).orderBy(F.desc("matched"), F.coalesce("mae", F.lit(float("inf"))), delta, F.desc(newest))
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_pair(pairs: DataFrame, record: list[str], delta: str, newest: str) -> DataFrame:
    """Where a candidate is one pair: the record's pair that matches, then of least error (none counts as infinite), then least delta, then newest. A partial minimum, no sort."""
    rank = F.struct(~F.col("match"), F.coalesce("abs_error", F.lit(float("inf"))), delta, -F.unix_micros(F.col(newest).cast("timestamp")))
    rest = [c for c in pairs.columns if c not in record]
    return pairs.groupBy(*record).agg(F.min_by(F.struct(*rest), rank).alias("_b")).select(*record, "_b.*")


def metrics(df: DataFrame, by: list[str] = (), digits: int = 6) -> DataFrame:
    """Counts, match rate and error statistics of compared rows: one row, or one for each of ``by``."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    stats = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("match").alias("matched"), F.count_if(F.col("observed").isNull()).alias("missing"), F.avg("abs_error").alias("mean"))
    stats = with_quantiles(stats, df, "abs_error", {"median": 0.5, "p90": 0.9}, by)
    return stats.select(
        *by, "total", "matched", "missing", r(F.try_divide(F.col("matched"), F.col("total"))).alias("match_rate"),
        r(F.col("mean")).alias("mean_abs_error"), r(F.col("median")).alias("median_abs_error"), r(F.col("p90")).alias("p90_abs_error"),
    )


def lag_grid(observed: DataFrame, lags: DataFrame, time: str) -> DataFrame:
    """Every observation at every lag (``lag_s``, seconds) of a small table: ``time`` moved by it."""
    return observed.crossJoin(few(lags)).withColumn(time, F.timestamp_add("MICROSECOND", (F.col("lag_s") * 1_000_000).cast("long"), F.col(time)))


def best_lag(per_lag: DataFrame) -> DataFrame:
    """The lag of the best match rate, then least error, then the least lag."""
    return per_lag.orderBy(F.desc("match_rate"), "mean_abs_error", "lag_s").limit(1)


def worst(df: DataFrame, n: int, *tiebreak: str) -> DataFrame:
    """The n greatest errors, those without a number first."""
    return df.orderBy(F.col("abs_error").desc_nulls_first(), *tiebreak).limit(n)


def truth_source(explicit: Column, outside: Column, auto: Column, fallback: Column, prefer_auto: Column | bool = False) -> Column:
    """Where the truth of a record comes from; each argument says whether that source is there (``outside``: the explicit one is out of the window)."""
    prefer = F.lit(prefer_auto) if isinstance(prefer_auto, bool) else prefer_auto
    return (
        F.when(prefer & auto, "cache_dir_search")
        .when(explicit & ~(outside & auto), "explicit_snapshot")
        .when(auto, "cache_dir_search")
        .when(fallback, "monitor_cache_fallback")
        .otherwise("skipped")
    )


def self_check(ocr: Column, capture: Column, elapsed_ms: Column, delta_s: Column) -> Column:
    """Timing check of a record: gap against the frame time, and the distance to truth."""
    gap = F.abs(F.timestamp_diff("MICROSECOND", capture, ocr) / 1000.0 - elapsed_ms)
    return F.when((gap <= F.greatest(F.lit(5000.0), 0.5 * elapsed_ms)) & (F.abs(delta_s) <= 3.0), "pass").otherwise("warn")
