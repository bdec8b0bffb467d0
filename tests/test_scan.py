import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import continuity, readings, scan

KINDS = {"total": sum, "most": max, "least": min}


def made(spark, seed, n=400):
    rng = random.Random(seed)
    keys = ["a"] * 6 + ["b", None]  # a hot one, and rows without a key
    rows = [(rng.choice(keys), o, rng.randint(0, 3), rng.choice([None, *range(20)])) for o in rng.sample(range(-500, 3000), n)]
    rows += [("empty", 5, 0, None), ("tie", 7, 1, 3), ("tie", 7, 2, 4)]
    return rows, spark.createDataFrame(rows, "k string, o long, o2 int, v long")


@pytest.mark.parametrize(("seed", "step"), [(1, 1), (2, 7), (3, 64), (4, 100_000)])
def test_running_values_equal_a_loop(spark, seed, step):
    rows, df = made(spark, seed)
    ops = {f"{kind}_{'to' if upto else 'before'}": getattr(scan, kind)(F.col("v"), upto) for kind in ("total", "most", "least", "latest") for upto in (True, False)}
    got = sorted((str(r.k), r.o, r.o2, *(r[n] for n in ops)) for r in scan.scan(df, ["k"], ["o", "o2"], step, **ops).collect())
    want = []
    for k, o, o2, v in rows:
        past = [x[3] for x in sorted((x for x in rows if x[0] == k and (x[1], x[2]) < (o, o2)), key=lambda x: x[1:3]) if x[3] is not None]
        values = []
        for n in ops:
            seen = past + ([v] if n.endswith("to") and v is not None else [])
            kind = n.partition("_")[0]
            values.append((seen[-1] if seen else None) if kind == "latest" else KINDS[kind](seen) if seen else 0 if kind == "total" else None)
        want.append((str(k), o, o2, *values))
    assert got == sorted(want)


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit("one").alias("k"), F.col("id").alias("o"), (F.col("id") % 3).alias("v"))
    step = scan.width(df, ["k"], "o", rows=500)
    assert 128 <= step <= 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ran = scan.scan(df, ["k"], ["o"], step, n=scan.total(F.lit(1)))
        tasks = [r["count"] for r in ran.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(tasks) < 15_000
    assert ran.where(F.col("n") != F.col("o") + 1).count() == 0
    plan = ran._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_part" in plan


def test_width(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.when(F.col("id") < 800, F.col("id") % 10).otherwise(F.col("id") * 100).alias("o"))
    assert scan.width(df, ["k"], "o", rows=90) == 1  # ten orders hold 800 rows: no step is narrow enough
    for rows in (100, 400, 5000):
        step = scan.width(df, ["k"], "o", rows=rows)
        largest = df.groupBy("k", scan.part_of("o", step)).count().agg(F.max("count")).first()[0]
        assert largest <= max(rows, 80)
    assert scan.width(df.limit(0), ["k"], "o") == 1


def test_readings_do_not_depend_on_parts(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.choice("ab"), i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(200)], "k string, o long, v double")
    for f in (lambda s: readings.hold_last(df, ["k"], "o", "v", step=s), lambda s: readings.changes(df, ["k"], "o", "v", s), lambda s: readings.islands(df, ["k"], "o", step=s), lambda s: readings.strictly_rising(df, ["k"], ["o"], "v", s)):
        assert sorted(map(str, f(5).collect())) == sorted(map(str, f(10_000).collect()))


def _bonus(v, p):
    if v is None or p is None:
        return 0.0
    r = abs(v - p) / max(abs(p), 1.0)
    return 0.25 if r <= 0.03 else 0.15 if r <= 0.10 else 0.05 if r <= 0.30 else -0.10


def _fold(frames):
    """One frame after another."""
    prior, out = None, []
    for o, cs in sorted(frames):
        scores = [(b + _bonus(v, prior), -i, v) for i, (v, b) in enumerate(cs)]
        score, back, v = max(scores, key=lambda s: s[:2]) if scores else (None, None, None)
        out.append((o, None if back is None else -back, v, prior, v if v is not None else prior, v is None and prior is not None))
        prior = v if v is not None else prior
    return out


@pytest.mark.parametrize(("seed", "step", "sure"), [(0, 30, 0.8), (1, 1, 0.8), (2, 7, 0.1), (3, 5000, 0.8)])
def test_continuity_equals_a_fold(spark, seed, step, sure):
    """Few frames are sure of a value in one case, so that stretches without an anchor are long."""
    rng = random.Random(seed)
    rows = []
    for k in ("a", None, "b"):
        x = 60.0
        for o in range(300 if k == "a" else 23):
            x += rng.uniform(-4, 4)
            none = rng.uniform(0.3, 1.1 if sure > 0.5 else 1.6)
            cs = [(round(x, 1) if rng.random() < sure else None, round(rng.uniform(0.5, 1.0), 3)), (round(x * rng.choice([10, 1.05, 0.5]), 1), round(rng.uniform(0.5, 1.0), 3)), (None, round(none, 3))]
            rows.append((k, 3 * o - 100, cs[: rng.choice([0, 1, 2, 3, 3, 3])]))
    df = spark.createDataFrame(rows, "k string, o long, candidates array<struct<value:double,base:double>>")
    got = sorted((str(r.k), r.o, r.choice, r.value, r.prior, r.held, r.imputed) for r in continuity.choose(df, ["k"], "o", step=step).collect())
    assert got == sorted((str(k), *x) for k in ("a", None, "b") for x in _fold([(o, c) for key, o, c in rows if key == k]))


def test_continuity_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o long, candidates array<struct<value:double,base:double>>")
    assert continuity.choose(df, ["k"], "o").count() == 0
    none = spark.createDataFrame([("a", 1, None), ("a", 2, [])], df.schema)
    assert [(r.choice, r.value, r.held) for r in continuity.choose(none, ["k"], "o").collect()] == [(None, None, None)] * 2
