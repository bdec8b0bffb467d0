"""The validator from end to end: records of readings against snapshots of truth.

Everything is long rows. ``records``: ``rec`` (unique), ``ref_ts`` (null if no time parsed), ``path`` and
``path_before`` (snapshots that the record names, or null). ``cells``: ``rec``, ``bed``, ``vital``, ``text``,
``value`` (as a text). ``snapshots``: ``snap`` (what a path names), ``snapshot_ts`` (of its name), ``event_ts``
(of its content) and, if some could not be read, ``loaded``. ``truth``: ``snap``, ``bed``, ``vital``, ``truth``. ``cache``:
the truth as it is now (``bed``, ``vital``, ``truth`` and, if its document has a time, ``event_ts``, the same in
all rows), or None. Times are instants or zoneless alike, but of one kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_number, invalid_reason, mismatch_tolerance, safe_float_finite, seconds_between
from . import asof
from .quantiles import quantiles
from .validate import truth_source


@dataclass(frozen=True)
class Settings:
    """What a run can be told. ``most``: candidates of a record, 0 for all; ``score_fields``: vitals that count, or None for all."""

    lookback_s: float = 12.0
    most: int = 40
    lag_s: float = 0.0
    nearest_past: bool = False
    prefer_auto: bool = False
    score_fields: tuple[str, ...] | None = None


def _scored(settings: Settings) -> Column:
    return F.lit(True) if settings.score_fields is None else F.col("vital").isin(list(settings.score_fields))


def compared(rows: DataFrame, truth: DataFrame, cells: DataFrame, tolerances: DataFrame, settings: Settings) -> DataFrame:
    """Truth-driven: each truth cell of a row's ``snap``, with the record's reading of it if there is one. Adds ``parsed``, ``tolerance``, ``abs_error``, ``scored`` and ``match``."""
    parsed = F.coalesce(safe_float_finite(F.col("value")), first_number(F.col("text")))
    read = cells.select("rec", "bed", "vital", "text", "value", parsed.alias("parsed"))
    out = rows.join(truth, "snap").join(read, ["rec", "bed", "vital"], "left").join(tolerances.select("vital", F.col("tol").alias("tolerance")), "vital", "left")
    error = F.abs(F.col("parsed") - F.col("truth"))
    out = out.withColumns({"tolerance": F.coalesce("tolerance", F.lit(0.0)), "abs_error": error, "scored": _scored(settings), "invalid_reason": invalid_reason(F.col("text"), F.col("parsed"))})
    return out.withColumn("match", F.coalesce(F.col("abs_error") <= F.col("tolerance"), F.lit(False)) & F.col("scored"))


def loaded(snapshots: DataFrame) -> Column:
    """Whether a listed snapshot could be read; without the column all could."""
    return F.coalesce(F.col("loaded"), F.lit(True)) if "loaded" in snapshots.columns else F.lit(True)


def explicit(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per record: the snapshot that its first path names, else the second; which of them (``key``), its time, and how many paths before it named none (``missing``) or one that could not be read (``load_errors``)."""
    named = snapshots.select("snap", F.coalesce("event_ts", "snapshot_ts").alias("ts"), loaded(snapshots).alias("ok"))
    one, two = (named.select(F.col("snap").alias(path), *[F.col(c).alias(f"_{c}{k}") for c in ("snap", "ts", "ok")]) for path, k in (("path", 1), ("path_before", 2)))
    found = records.select("rec", "path", "path_before").join(one, "path", "left").join(two, "path_before", "left")
    first, second = F.coalesce("_ok1", F.lit(False)), F.coalesce("_ok2", F.lit(False))
    absent = lambda path, k: (F.col(path).isNotNull() & F.col(f"_ok{k}").isNull()).cast("int")
    broken = lambda k: F.coalesce(~F.col(f"_ok{k}"), F.lit(False)).cast("int")
    return found.select(
        "rec", F.when(first, F.col("_snap1")).when(second, F.col("_snap2")).alias("explicit"), F.when(first, F.col("_ts1")).when(second, F.col("_ts2")).alias("explicit_ts"),
        F.when(first, "path").when(second, "path_before").alias("key"),
        F.when(first, F.lit(0)).otherwise(absent("path", 1) + absent("path_before", 2)).alias("missing"), F.when(first, F.lit(0)).otherwise(broken(1) + broken(2)).alias("load_errors"),
    )


def automatic(records: DataFrame, snapshots: DataFrame, truth: DataFrame, cells: DataFrame, tolerances: DataFrame, settings: Settings) -> DataFrame:
    """Per record with a candidate: ``auto`` (the snapshot of most matches, then least mean error, then nearest, then last by name; null if none could be read), ``auto_ts``, ``candidates`` and ``nearest_used``."""
    timed = records.where("ref_ts is not null").select("rec", F.col("rec").alias("_left"), "ref_ts")
    right = snapshots.where("snapshot_ts is not null").select("snap", "snapshot_ts", loaded(snapshots).alias("ok"))
    near = asof.range_join(timed, right, "ref_ts", "snapshot_ts", settings.lookback_s, most=settings.most or None, order=[F.desc("snap")])
    near = near.select("rec", "ref_ts", "snap", "snapshot_ts", "ok", F.lit(False).alias("nearest_used"))
    if settings.nearest_past:
        rest = timed.drop("_left").join(near.select("rec").distinct(), "rec", "left_anti")
        one = right.groupBy("snapshot_ts").agg(F.max(F.struct("snap", "ok")).alias("_o")).select("_o.*", "snapshot_ts")  # of one time the last by name
        last = asof.asof(rest, one, "ref_ts", "snapshot_ts").where("snap is not null")
        near = near.unionByName(last.select("rec", "ref_ts", "snap", "snapshot_ts", "ok", F.lit(True).alias("nearest_used")))
    pairs = compared(near.where("ok").select("rec", "snap"), truth, cells, tolerances, settings)
    scored = pairs.groupBy("rec", "snap").agg(F.count_if("match").alias("matched"), F.avg(F.when(F.col("scored"), F.col("abs_error"))).alias("mae"))
    ranked = near.join(scored, ["rec", "snap"], "left").withColumn("delta", seconds_between(F.col("ref_ts"), F.col("snapshot_ts")))
    rank = F.struct(F.coalesce("matched", F.lit(0)), -F.coalesce("mae", F.lit(float("inf"))), -F.col("delta"), F.col("snap"))
    return ranked.groupBy("rec").agg(
        F.max_by(F.struct("snap", "snapshot_ts"), F.when(F.col("ok"), rank)).alias("b"), F.count("*").alias("candidates"), F.bool_or("nearest_used").alias("nearest_used")
    ).select("rec", F.col("b.snap").alias("auto"), F.col("b.snapshot_ts").alias("auto_ts"), "candidates", "nearest_used")


def choose(records: DataFrame, cells: DataFrame, snapshots: DataFrame, truth: DataFrame, cache: DataFrame | None, tolerances: DataFrame, settings: Settings) -> DataFrame:
    """Per record: ``source`` and ``snap`` of its truth (null from the cache), ``truth_ts``, ``dt_s`` or ``dt_skipped`` (why there is none), ``candidates``, ``nearest_used``, ``key``, ``missing``, ``load_errors``."""
    lag = F.timestamp_add("MICROSECOND", F.lit(int(settings.lag_s * 1_000_000)), F.col("ref_ts"))
    moved = records.withColumn("ref_ts", lag)
    both = moved.join(explicit(moved, snapshots), "rec").join(automatic(moved, snapshots, truth, cells, tolerances, settings), "rec", "left")
    if cache is not None and "event_ts" in cache.columns:
        both = both.join(F.broadcast(cache.agg(F.max("event_ts").alias("_now"))), how="cross")  # one row
    else:
        both = both.withColumn("_now", F.lit(None).cast(records.schema["ref_ts"].dataType))
    outside = F.coalesce(F.abs(seconds_between(F.col("ref_ts"), F.col("explicit_ts"))) > max(settings.lookback_s, 0.0), F.lit(False))
    has_auto, has_explicit = F.col("auto").isNotNull(), F.col("explicit").isNotNull()
    both = both.withColumn("source", truth_source(has_explicit, outside, has_auto, F.lit(cache is not None), settings.prefer_auto))
    auto = F.col("source") == "cache_dir_search"
    named = F.col("source") == "explicit_snapshot"
    tried = ~(auto & F.lit(settings.prefer_auto))  # paths are not looked at where the search came first and found one
    searched = F.lit(settings.prefer_auto) | ~has_explicit | outside
    both = both.select(
        "rec", "ref_ts", "source", F.when(auto, F.col("auto")).when(named, F.col("explicit")).alias("snap"),
        F.when(auto, F.col("auto_ts")).when(named, F.col("explicit_ts")).when(F.col("source") != "skipped", F.col("_now")).alias("truth_ts"),
        F.when(searched, F.coalesce("candidates", F.lit(0))).otherwise(0).alias("candidates"), (auto & F.coalesce("nearest_used", F.lit(False))).alias("nearest_used"),
        F.when(tried, F.col("key")).alias("key"), F.when(tried, F.col("missing")).otherwise(0).alias("missing"), F.when(tried, F.col("load_errors")).otherwise(0).alias("load_errors"),
    )
    dt = F.coalesce(seconds_between(F.col("ref_ts"), F.col("truth_ts")), F.when(F.col("source") == "explicit_snapshot", F.lit(0.0)))
    why = F.when(F.col("ref_ts").isNull() & F.col("truth_ts").isNull(), "ocr_dt_none+truth_dt_none").when(F.col("ref_ts").isNull(), "ocr_dt_none").otherwise("truth_dt_none")
    return both.withColumn("dt_s", dt).withColumn("dt_skipped", F.when((F.col("source") != "skipped") & F.col("dt_s").isNull(), why))


def run(records: DataFrame, cells: DataFrame, snapshots: DataFrame, truth: DataFrame, cache: DataFrame | None, tolerances: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The chosen truth of each record (see ``choose``), and its comparisons (see ``compared``), with ``mismatch`` (beyond the display tolerance)."""
    chosen = choose(records, cells, snapshots, truth, cache, tolerances, settings)
    rows = chosen.where("source <> 'skipped'").select("rec", F.coalesce("snap", F.lit("")).alias("snap"))
    whole = truth if cache is None else truth.unionByName(cache.select(F.lit("").alias("snap"), "bed", "vital", "truth"))
    found = compared(rows, whole.where("vital is not null"), cells, tolerances, settings)
    beyond = F.coalesce(F.col("abs_error") > mismatch_tolerance(F.col("vital"), F.col("parsed"), F.col("truth")), F.lit(False))
    return chosen, found.withColumn("mismatch", beyond)


def metrics(chosen: DataFrame, comparisons: DataFrame, digits: int = 6) -> DataFrame:
    """One row of 22 measures of a run; counts of reasons are maps as JSON texts, in order of the reasons."""
    own = comparisons.where("scored")
    of_cells = own.agg(
        F.count("*").alias("total"), F.count_if("match").alias("matched"), F.avg("abs_error").alias("mae"),
        F.count_if(F.col("parsed").isNull()).alias("missing"), F.count_if(F.col("parsed").isNull() & F.col("invalid_reason").isNotNull()).alias("invalid"),
    )
    dt = chosen.where("source <> 'skipped'").select(F.abs("dt_s").alias("x"))
    n = lambda c: F.count_if(c).cast("long")
    explicit_used, key = F.col("source") == "explicit_snapshot", F.col("key")
    reasons = chosen.where("dt_skipped is not null").groupBy("dt_skipped").agg(F.count("*").alias("n"))
    reasons = reasons.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "dt_skipped", F.lit('":'), F.col("n").cast("string")))), ","), F.lit("}")).alias("dt_skip_reason_counts"))  # three reasons at most
    of_records = chosen.agg(
        n(key == "path_before").alias("snapshot_before_used"), n(key == "path").alias("snapshot_used"), n(explicit_used).alias("explicit_used"), n(F.col("source") == "cache_dir_search").alias("auto_used"),
        n((F.col("source") == "monitor_cache_fallback") | F.col("nearest_used")).alias("fallback_used"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("snapshot_missing"), F.coalesce(F.sum("load_errors"), F.lit(0)).cast("long").alias("snapshot_load_error"),
        n(F.col("source") == "skipped").alias("skipped_truth_unavailable"), n("nearest_used").alias("nearest_fallback_used"),
        F.avg(F.when(F.col("source") != "skipped", F.abs("dt_s"))).alias("dt_mean"), n((F.col("source") != "skipped") & F.col("dt_s").isNotNull()).alias("dt_evaluated"), n(F.col("dt_skipped").isNotNull()).alias("dt_skipped_n"),
    )
    errors = quantiles(own.select(F.col("abs_error").alias("x")), "x", {"median_abs_error": 0.5})
    times = quantiles(dt, "x", {"dt_median_seconds": 0.5, "dt_p90_seconds": 0.9})
    # Tables of one row each.
    out = of_cells.crossJoin(of_records).crossJoin(reasons).join(errors, F.lit(True), "left").join(times, F.lit(True), "left")
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    rate = lambda c: r(F.try_divide(F.col(c), F.col("total")))
    skipped = F.col("skipped_truth_unavailable")
    return out.select(
        "total", rate("matched").alias("match_rate"), r(F.col("mae")).alias("mean_abs_error"), r(F.col("median_abs_error")).alias("median_abs_error"), rate("missing").alias("missing_rate"), rate("invalid").alias("invalid_rate"),
        "snapshot_before_used", "snapshot_used", "explicit_used", "auto_used", "fallback_used", "snapshot_missing", "snapshot_load_error", "skipped_truth_unavailable",
        F.when(skipped > 0, F.concat(F.lit('{"truth_unavailable":'), skipped.cast("string"), F.lit("}"))).otherwise("{}").alias("skip_reason_counts"), "nearest_fallback_used",
        r(F.col("dt_mean")).alias("dt_mean_seconds"), r(F.col("dt_median_seconds")).alias("dt_median_seconds"), r(F.col("dt_p90_seconds")).alias("dt_p90_seconds"),
        "dt_evaluated", F.col("dt_skipped_n").alias("dt_skipped"), "dt_skip_reason_counts",
    )
