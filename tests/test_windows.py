import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import asof, windows
from wardline.plans import registry

ODD = [None, math.nan, math.inf, -math.inf, 0.0, 1e-17, 2e-17]


def error(o, t):
    return math.inf if o is None or t is None else abs(o - t)


def order(e):
    return (math.isnan(e), 0.0 if math.isnan(e) else e)


def test_closest_of_ranges_equals_brute_force():
    r = random.Random(5)
    for _ in range(300):
        n, m = r.choice([0, 1, 2, 7, 40, 130]), 30
        pool = r.choice([ODD, [0.1 * k for k in range(9)], [*ODD, 1.5, 2.5, 100.0]])
        v, x = ([r.choice(pool) for _ in range(k)] for k in (n, m))
        lo = np.array([r.randint(0, n) for _ in x])
        hi = np.array([r.randint(0, n) for _ in x])
        numbers = lambda a: (np.array([math.nan if y is None else y for y in a], float), np.array([y is None for y in a], bool))
        with np.errstate(invalid="ignore"):
            i, j = windows.closest(*numbers(v), lo, hi, *numbers(x))
        expected = {q: min(range(lo[q], hi[q]), key=lambda k: (order(error(x[q], v[k])), -k)) for q in range(m) if lo[q] < hi[q]}
        assert dict(zip(i.tolist(), j.tolist(), strict=True)) == expected


def tables(spark, n, span, seed):
    r = random.Random(seed)
    pool = [*ODD, *[k / 4 for k in range(12)]]
    row = lambda k: (k, r.choice(["a", "a", "b", None]), r.choice([None, *[r.randrange(-span, span) for _ in range(9)]]), r.choice(pool))
    lefts, rights = [row(k) for k in range(n)], [row(k) for k in range(n)]
    at = F.timestamp_add("SECOND", F.col("s"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    left = spark.createDataFrame(lefts, "_left long, key string, s long, x double").select("_left", "key", at.alias("lt"), "x")
    right = spark.createDataFrame(rights, "id long, key string, s long, v double").select("id", "key", at.alias("rt"), "v")
    return lefts, rights, left, right


@pytest.mark.parametrize("rows", [10, 50_000])
@pytest.mark.parametrize("span", [1, 20, 900])
def test_pairs_of_windows_equal_brute_force(spark, rows, span):
    lefts, rights, left, right = tables(spark, 150, span, rows + span)
    inside = {k: [t for t in rights if key is not None and t[1] == key and s is not None and t[2] is not None and s - 30 <= t[2] <= s] for k, key, s, _ in lefts}
    args = (left, right, asof.micros("lt"), asof.micros("rt"), 30_000_000, ["key"])
    found = windows.closest_pairs(*args, ("x", "v"), [F.asc("id")], rows).collect()
    expected = {(k, min(inside[k], key=lambda t: (order(error(x, t[3])), -t[2], t[0]))[0]) for k, _, _, x in lefts if inside[k]}
    assert len(found) == len(expected) and {(r["_left"], r["id"]) for r in found} == expected
    found = windows.newest_pairs(*args, 3, [F.desc("id")], rows).collect()
    expected = {(k, t[0]) for k, *_ in lefts for t in sorted(inside[k], key=lambda t: (-t[2], -t[0]))[:3]}
    assert len(found) == len(expected) and {(r["_left"], r["id"]) for r in found} == expected


def test_wide_join_with_most_keeps_unmatched_rows(spark):
    _, _, left, right = tables(spark, 60, 200, 3)
    found = asof.range_join(left.drop("key"), right.drop("key"), "lt", "rt", 30, most=2, order=[F.desc("id")], how="left")
    assert {r["_left"] for r in found.select("_left").collect()} == set(range(60))


@pytest.mark.parametrize("name", ["best_candidate", "range_join_lookback", "match_metrics", "match_metrics_overall", "dt_stats", "worst_mismatches"])
def test_dense_windows_make_no_pairs(spark, tmp_path, name):
    """2,000 rows in one window: all pairs would be a million; no step of the plan may give out more than rows times a few."""
    e = spark.range(2000).select(
        F.col("id").alias("event_id"), F.timestamp_add("MICROSECOND", F.col("id") * 1000, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("hr").alias("event_type"), ((F.col("id") * 37) % 101).cast("double").alias("value"),
    )
    e.write.parquet(str(tmp_path / "events.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    df.collect()
    rows = []

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            rows.append(metric.get().value())
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            inner = [node.plan()]
        for k in range(node.children().size()):
            inner.append(node.children().apply(k))
        for n in inner:
            walk(n)

    walk(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 10_000
