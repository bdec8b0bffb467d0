"""The lag of the record's clock that agrees best with truth: every lag of a grid from one pass over the pairs.

What a record would be compared with changes only at some lags: a snapshot is a candidate over one interval
of them, is the latest past one over another, and a named snapshot is within its window over a third. Pairs
are compared once, whatever the lags; along the sorted ends of a record's intervals the best of those open
is chosen, and what it counts is added at the lag where it is first chosen and taken away where it no longer is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, scan
from .validation import Settings, compared, explicit, loaded

#: The half-second grid of ten seconds to either side.
GRID = tuple(x * 0.5 for x in range(-20, 21))
#: In what order truths are taken: named and within the window, searched, nothing (all that was found could not be read), the latest past one, named at any time, the cache.
NAMED, SEARCHED, UNREAD, NEAREST, NAMED_FAR, CACHE = range(6)
FAR = 1 << 62


def snapshots_in_order(snapshots: DataFrame, most: int, step: int | None = None) -> DataFrame:
    """``snap``, ``ok``, ``t`` (microseconds), and the times of the next snapshot (``next``) and of the one that puts it out of the newest ``most`` (``out``)."""
    listed = snapshots.where("snapshot_ts is not null").select("snap", loaded(snapshots).alias("ok"), "snapshot_ts", asof.micros("snapshot_ts").alias("t"))
    ranked = scan.scan(listed, [], ["t", "snap"], step or scan.width(listed, [], "t"), _nth=scan.total(F.lit(1)))
    after = lambda k, name: ranked.select((F.col("_nth") - k).alias("_nth"), F.col("t").alias(name))
    out = ranked.join(after(1, "next"), "_nth", "left")
    out = out.join(after(most, "out"), "_nth", "left") if most > 0 else out.withColumn("out", F.lit(None).cast("long"))
    return out.select("snap", "ok", "snapshot_ts", "t", F.coalesce("next", F.lit(FAR)).alias("next"), F.coalesce("out", F.lit(FAR)).alias("out"))


def auto_lag(
    records: DataFrame, cells: DataFrame, snapshots: DataFrame, truth: DataFrame, cache: DataFrame | None, tolerances: DataFrame, lags: Sequence[float] = GRID, settings: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """``lag_s``, ``total``, ``matched``, ``match_rate``, ``mean_abs_error`` and ``best`` of each lag of the grid.

    The best has the greatest match rate, then the least mean error, then is the first. What each record is
    compared with at a lag is what ``validation.run`` would choose with that ``lag_s``. Tables are as there. A lag
    at which nothing is compared has rate and error 0. Errors are summed in decimals, so that taking away
    undoes adding.
    """
    lags = sorted(float(x) for x in lags)
    spark = records.sparkSession
    us = [round(x * 1_000_000) for x in lags]
    grid = F.array(*[F.lit(x).cast("long") for x in us])
    look = int(settings.lookback_s * 1_000_000)
    first_at = lambda low: F.size(F.filter(grid, lambda x: x < low))  # noqa: E731  number of the first lag at or after ``low``
    after = lambda high: F.size(F.filter(grid, lambda x: x <= high))  # noqa: E731  of the first beyond ``high``
    whole = (F.lit(0), F.lit(len(lags)))
    moved = F.timestamp_add("MICROSECOND", F.lit(us[-1]), F.col("ref_ts"))
    own = records.where("ref_ts is not null").select("rec", F.col("rec").alias("_left"), asof.micros("ref_ts").alias("ref"), moved.alias("_end"))
    ordered = snapshots_in_order(snapshots, settings.most)
    reach = (look + us[-1] - us[0]) / 1e6
    near = asof.range_join(own, ordered, "_end", "snapshot_ts", reach).select("rec", "ref", "snap", "ok", "t", "next", "out")
    low = F.col("t") - F.col("ref")
    upto = F.least(after(low + look), after(F.col("out") - F.col("ref") - 1))
    parts = [near.select("rec", "snap", F.when(F.col("ok"), SEARCHED).otherwise(UNREAD).alias("kind"), "t", first_at(low).alias("a"), upto.alias("b"))]
    if settings.nearest_past:
        begin = F.timestamp_add("MICROSECOND", F.lit(us[0] - us[-1]), F.col("_end"))
        past = asof.asof(own.select("rec", "ref", begin.alias("_begin")), ordered.where("next > t"), "_begin", "snapshot_ts").where("snap is not null").select(*near.columns)
        held = near.union(past).where("ok")
        parts.append(held.select("rec", "snap", F.lit(NEAREST).alias("kind"), "t", first_at(low).alias("a"), after(F.col("next") - F.col("ref") - 1).alias("b")))
    named = records.select("rec", "ref_ts").join(explicit(records, snapshots), "rec").where("explicit is not null").select("rec", F.col("explicit").alias("snap"), asof.micros("ref_ts").alias("ref"), asof.micros("explicit_ts").alias("t"))
    away = F.col("t") - F.col("ref")
    if not settings.prefer_auto:
        inside = (F.coalesce(first_at(away - max(look, 0)), whole[0]), F.coalesce(after(away + max(look, 0)), whole[1]))
        timed = F.col("t").isNotNull() & F.col("ref").isNotNull()
        parts.append(named.select("rec", "snap", F.lit(NAMED).alias("kind"), "t", F.when(timed, inside[0]).otherwise(whole[0]).alias("a"), F.when(timed, inside[1]).otherwise(whole[1]).alias("b")))
    parts.append(named.select("rec", "snap", F.lit(NAMED_FAR).alias("kind"), "t", whole[0].alias("a"), whole[1].alias("b")))
    if cache is not None:
        parts.append(records.select("rec", F.lit("").alias("snap"), F.lit(CACHE).alias("kind"), F.lit(None).cast("long").alias("t"), whole[0].alias("a"), whole[1].alias("b")))
        truth = truth.unionByName(cache.select(F.lit("").alias("snap"), "bed", "vital", "truth"))
    items = parts[0]
    for p in parts[1:]:
        items = items.union(p)
    items = items.where("a < b")

    # Each pair compared once.
    pairs = compared(items.where(F.col("kind") != UNREAD).select("rec", "snap").distinct(), truth.where("vital is not null"), cells, tolerances, settings).where("scored")
    exact = F.col("abs_error").cast("decimal(28,12)")
    scored = pairs.groupBy("rec", "snap").agg(F.count("*").alias("total"), F.count_if("match").alias("matched"), F.avg("abs_error").alias("mae"), F.sum(exact).alias("error"), F.count("abs_error").alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = F.struct(zero("total").alias("total"), zero("matched").alias("matched"), F.coalesce("error", F.lit(0).cast("decimal(38,12)")).alias("error"), zero("errors").alias("errors"))
    rank = F.struct((-F.col("kind")).alias("kind"), zero("matched").alias("matched"), (-F.coalesce("mae", F.lit(float("inf")))).alias("mae"), "t", "snap", counts.alias("n"))
    # Of the pairs of a record with one interval only the best can be chosen: as many are left as the grid has intervals, at most.
    best = items.join(scored, ["rec", "snap"], "left").groupBy("rec", "kind", "a", "b").agg(F.max(rank).alias("r"))
    swept = best.groupBy("rec").agg(F.collect_list(F.struct("a", "b", "r")).alias("all")).withColumn("ends", F.array_sort(F.array_distinct(F.concat(F.transform("all", lambda x: x["a"]), F.transform("all", lambda x: x["b"])))))

    def chosen(at: Column) -> Column:
        open_ = F.filter("all", lambda x: (x["a"] <= at) & (x["b"] > at))
        top = F.array_max(F.transform(open_, lambda x: x["r"]))
        other = F.array_max(F.transform(F.filter(open_, lambda x: x["r"]["kind"] <= -NAMED_FAR), lambda x: x["r"]))
        return F.when(top["kind"] == -UNREAD, other).otherwise(top)

    spans = F.transform("ends", lambda e, i: F.struct(e.alias("a"), F.get("ends", i + 1).alias("b"), chosen(e)["n"].alias("n")))
    spans = swept.select(F.explode(spans).alias("s")).where("s.n is not null and s.b is not null")
    steps = F.explode(F.array(F.struct(F.col("s.a").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("s.b").alias("at"), F.lit(-1).alias("sign"))))
    names = ("total", "matched", "error", "errors")
    changes = spans.select("s.n", steps.alias("e")).groupBy("e.at").agg(*[F.sum(F.col(f"n.{c}") * F.col("e.sign")).alias(c) for c in names])
    table = spark.createDataFrame(list(enumerate(lags)), "at int, lag_s double")
    upto_here = Window.orderBy("at")  # a row a lag
    run = F.broadcast(table).join(changes, "at", "left").select("at", "lag_s", *[zero(F.sum(c).over(upto_here)).alias(c) for c in names])
    rate, error = F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)), F.coalesce((F.col("error").cast("double") / F.nullif("errors", F.lit(0))), F.lit(0.0))
    out = run.select("at", "lag_s", F.col("total").cast("long").alias("total"), F.col("matched").cast("long").alias("matched"), rate.alias("match_rate"), error.alias("mean_abs_error"))
    place = F.row_number().over(Window.orderBy(F.desc("match_rate"), "mean_abs_error", "at"))
    return out.withColumn("best", place == 1).drop("at")
