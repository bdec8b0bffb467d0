import pytest
from pyspark.sql import functions as F

from wardline.functions import dims
from wardline.functions import reading_text as R
from wardline.functions import scalars as S
from wardline.operators import asof, engines, geometry, messages, readings, validate

SAMPLE = "MSH|^~\\&|A|B|C|D|20260219101112+0900||ORU^R01|42|P|2.5\rPID|1||P1^x||YAMADA^TARO\rPV1|1|I|ICU^01^BED01\rOBX|1|NM|8867-4^Heart Rate^LN||> 75|bpm|60-100|N|||F|||20260219101110\rOBX|2|ST|X^Y||1|u\rOBX|3|NM|HR^HR||76|bpm\rOBX|4|SN|ZZ^other||1-2|u|||||P\rOBX|5|NM|ICU_SPO2^s"


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(x,) for x in rows], f"x {kind}")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_parse(spark):
    other = "MSH#@~\\&#####202602191011##ORU\nPID###P2#####\nPV1###ICU@BED02\nOBX##NM#HR@HR##80#bpm"
    df = spark.createDataFrame([(1, SAMPLE), (2, other), (3, "PID|x"), (4, ""), (5, None), (6, "MSH")], "id int, message string")
    got = {r.id: r for r in messages.parse(df).collect()}
    assert set(got) == {1, 2, 6}
    r = got[1]
    assert (r.message_type, str(r.message_time), r.control_id, r.patient_id, r.patient_name, r.bed_id) == ("ORU^R01", "2026-02-19 10:11:12", "42", "P1", "YAMADA TARO", "BED01")
    assert [(o.vital, o.value, o.status) for o in r.observations] == [("HR", 76.0, "F"), ("other", None, "P")]
    assert (got[2].bed_id, got[2].observations[0].value, str(got[2].message_time)) == ("BED02", 80.0, "2026-02-19 10:11:00")
    assert got[6].observations == [] and got[6].bed_id == ""
    reply = messages.acknowledgement(F.lit("ORU^R01"), F.lit(True), F.lit("20260101000000"))
    assert values(spark, [1], "int", messages.is_acknowledged(reply)) == [(True,)]
    assert values(spark, [SAMPLE], "string", F.size(messages.frames(messages.framed(F.col("x")))), F.get(messages.frames(messages.framed(F.col("x"))), F.lit(0)) == F.col("x")) == [(1, True)]


@pytest.mark.parametrize(
    ("text", "expected"), [("1", 1.0), (" 1.5 ", 1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1_0", None), ("", None), (None, None), ("-inf", float("-inf")), ("x", None)]
)
def test_safe_float(spark, text, expected):
    assert values(spark, [text], "string", S.safe_float(F.col("x"))) == [(expected,)]


def test_scalars(spark):
    x = F.col("x")
    assert values(spark, ["12/80", "1e3", "1-2", "> 1,0.5"], "string", S.clean_number(x)) == [(1280.0,), (13.0,), (None,), (10.5,)]
    assert values(spark, ["a 1,234.50 b", "-7x", "none"], "string", S.first_number(x)) == [(1234.5,), (-7.0,), (None,)]
    assert values(spark, [75.0, 36.5, -0.25, 1e16], "double", S.canonical_number(x)) == [("75",), ("36.5",), ("-0.25",), ("10000000000000000",)]
    assert values(spark, [36.25, 36.35, None], "double", S.display_value(F.lit("TSKIN"), x)) == [("36.2",), ("36.4",), ("....",)]
    assert values(spark, [2.5, 3.5], "double", S.display_value(F.lit("HR"), x)) == [("2",), ("4",)]
    assert values(spark, ["20240230", "20240229", "202402291530", "20240229153001-0500", "x"], "string", S.message_time(x).cast("string")) == [(None,), ("2024-02-29 00:00:00",), ("2024-02-29 15:30:00",), ("2024-02-29 15:30:01",), (None,)]
    assert values(spark, ["2024-01-01T00:00:00Z", "2024-01-01 09:00:00", "2024", "2024-01-01T09:00:00.5+09:00"], "string", S.iso_time(x).cast("string")) == [("2024-01-01 00:00:00",), ("2024-01-01 00:00:00",), (None,), ("2024-01-01 00:00:00.5",)]
    assert values(spark, ["2024-01-01T00:00:00Z"], "string", S.tokyo_iso(S.iso_time(x))) == [("2024-01-01T09:00:00+09:00",)]
    assert values(spark, ["YES", "0", None], "string", S.truthy(x)) == [(True,), (False,), (False,)]
    assert values(spark, [" EasyOCR", "Tesseract", "?"], "string", S.engine_name(x)) == [("easy",), ("tess",), (None,)]
    assert values(spark, ["a, b,,a"], "string", S.csv_set(x)) == [(["a", "b"],)]
    assert values(spark, ["", "--"], "string", S.invalid_reason(x, F.lit(None).cast("double"))) == [("empty",), ("invalid_numeric:--",)]
    assert values(spark, ["123.6"], "string", S.shorter_texts(x)) == [(["123.6", "124", "123."],)]


def test_reading_texts(spark):
    rows = [("TSKIN", "365"), ("TSKIN", "36.5"), ("TSKIN", "99.9"), ("HR", "１２０"), ("HR", "O O"), ("HR", "12/80"), ("CVP_M", "-.7"), ("CVP_M", "7."), ("SpO2", "98.6"), ("XX", "5"), ("HR", None)]
    df = spark.createDataFrame(rows, "v string, t string")
    v, t = F.col("v"), F.col("t")
    got = [tuple(r) for r in df.select(R.digits_like(v, t), R.parsed_number(v, R.digits_like(v, t)), R.parsed_reading(v, R.normalized(v, t)), R.well_formed(v, R.normalized(v, t))).collect()]
    assert got[0][:2] == ("365", 36.5) and got[0][2] is None and got[1] == ("36.5", 36.5, 36.5, True) and got[2][1] is None
    assert got[3] == ("120", 120.0, 120.0, True) and got[4][0] == "00" and got[5][0] == "1280"
    assert got[6][0] == "-0.7" and got[7][0] == "7" and got[8][0] == "986" and got[9][1] == 5.0 and got[10][0] == ""


def test_asof_ties_and_carry(spark):
    left = spark.createDataFrame([(1, "k", "2024-01-01 00:00:10"), (2, "k", "2024-01-05 00:00:00"), (3, "z", "2024-01-01 00:00:10"), (4, "k", "2023-01-01 00:00:00")], "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([("k", "2024-01-01 00:00:10", 7), ("k", "2024-01-02 00:00:00", 8)], "k string, rt string, v int").withColumn("rt", F.col("rt").cast("timestamp_ntz"))
    assert {r.id: r.v for r in asof.asof(left, right, "t", "rt", ["k"], 3600).collect()} == {1: 7, 2: 8, 3: None, 4: None}
    assert {r.id: r.v for r in asof.asof(left, right, "t", "rt", ["k"], 3600, strict=True).collect()} == {1: None, 2: 8, 3: None, 4: None}
    assert {r.id: r.v for r in asof.asof(left, right, "t", "rt", ["k"], 3600, forward=True).collect()} == {1: 7, 2: None, 3: None, 4: 7}
    near = {r.id: (r.v, r.delta_s) for r in asof.nearest(left, right, "t", "rt", 60, ["k"], 3600).collect()}
    assert near[1] == (7, 0.0) and near[2] == (8, -259200.0) and near[3] == (None, None) and near[4][0] == 7


def test_time_joins_are_no_nested_loops(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a, b = e.select(F.col("event_id").alias("_left"), "ts", "event_type"), e.select(F.col("ts").alias("rt"), "event_type", "value")
    for df in (asof.range_join(a, b, "ts", "rt", 60, ["event_type"]), asof.range_join(a, b.drop("event_type"), "ts", "rt", 60), asof.asof(a, b, "ts", "rt", ["event_type"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_validation(spark):
    rows = [("HR", 75.0, 76.0), ("HR", 80.0, 76.0), ("TSKIN", 36.5, 36.65), ("ART_S", 100.0, 100.5), ("HR", None, 70.0), ("HR", float("nan"), 70.0)]
    df = validate.compare(validate.with_tolerance(spark.createDataFrame(rows, "vital string, observed double, truth double"), dims.tolerance_dim(spark)))
    got = [(r.tol, r.match, r.mismatch) for r in df.collect()]
    assert got == [(1.0, True, False), (1.0, False, True), (0.1, False, False), (0.0, False, True), (1.0, False, False), (1.0, False, False)]
    m = validate.metrics(df.where("not isnan(observed) or observed is null")).first()
    assert (m.total, m.matched, m.missing) == (5, 1, 1)
    lag = spark.createDataFrame([(0.5, 0.9, 1.0), (0.0, 0.9, 1.0), (1.0, 0.8, 0.0)], "lag_s double, match_rate double, mean_abs_error double")
    assert validate.best_lag(lag).first().lag_s == 0.0
    check = validate.self_check(F.lit("2024-01-01 00:00:01").cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(900.0), F.lit(2.0))
    assert spark.range(1).select(check.alias("c")).first().c == "pass"
    pairs = spark.createDataFrame([(1, "a", True, 0.1, 5.0, 1), (1, "a", False, 3.0, 5.0, 1), (1, "b", True, 0.1, 2.0, 2), (1, "b", False, 3.0, 2.0, 2)], "rec int, snap string, match boolean, abs_error double, dt double, seq int")
    assert validate.best_candidate(pairs, ["rec"], ["snap"], "dt", "seq").first().snap == "b"


def test_confusion_counts_only_digits(spark):
    df = spark.createDataFrame([(75.0, "7S5"), (36.5, "36"), (1.0, None), (2.0, "")], "truth double, read string")
    got = {(r.truth_digit, r.pred_digit): r["count"] for r in engines.digit_confusion(df).collect()}
    assert got == {("7", "7"): 1, ("5", "5"): 1, ("3", "3"): 1, ("6", "6"): 1, ("5", "_"): 1, ("2", "_"): 1}


def test_geometry(spark):
    g = geometry.grid(spark, 200, 300)
    assert g.count() == 120
    assert geometry.inset(g, 5, 200, 300).where("x1 < 5 or y1 < 5").count() == 0
    w = geometry.widened(g, ["VTi"], 0.3, 200).join(g.select("bed", "vital", F.col("x2").alias("old")), ["bed", "vital"])
    assert w.where("vital <> 'VTi' and x2 <> old").count() == 0 and w.where("vital = 'VTi' and x2 > old").count() == 6


def test_scores(spark):
    score = readings.candidate_score(F.lit(None).cast("double"), F.lit("120"), F.lit(True), F.lit(120.0), F.lit(118.0))
    assert abs(spark.range(1).select(score.alias("s")).first().s - (0.525 + 0.8 + 0.24 + 0.2 + 0.25)) < 1e-9


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from wardline.operators.quantiles import quantiles

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 100, 999), "b": np.round(rng.exponential(1, 500), 1), None: np.array([-3.0, 0.0, 0.0, 2.5]), "one": np.array([7.0]), "wide": np.array([-1e300, -1e-300, 0, 1e-300, 1e300])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("null", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in quantiles(df, "x", {"p0": 0.0, "m": 0.5, "p9": 0.9, "p1": 1.0}, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert np.allclose([got[g].p0, got[g].m, got[g].p9, got[g].p1], np.quantile(xs, [0, 0.5, 0.9, 1]), rtol=1e-12)
    every = np.concatenate(list(groups.values()))
    assert np.isclose(quantiles(df, "x", {"m": 0.5}).first().m, np.median(every))
    assert quantiles(df.limit(0), "x", {"m": 0.5}).count() == 0


def test_validator_sources_and_lags(spark):
    from wardline.operators import validation as V

    t = "timestamp_ntz"
    ts = lambda s: f"2024-01-01 00:00:{s:02d}"
    as_time = lambda rows, schema, *cols: spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast(t) for c in cols})
    snapshots = as_time([("s1", ts(10), None), ("s2", ts(20), ts(21)), ("s3", ts(50), None)], "snap string, snapshot_ts string, event_ts string", "snapshot_ts", "event_ts")
    truth = spark.createDataFrame([("s1", "b", "HR", 60.0), ("s2", "b", "HR", 80.0), ("s3", "b", "HR", 99.0)], "snap string, bed string, vital string, truth double")
    cells = spark.createDataFrame([(r, "b", "HR", None, "60") for r in range(7)], "rec long, bed string, vital string, text string, value string")
    records = as_time([
        (0, ts(22), None, None),  # two candidates: s1 matches
        (1, ts(22), "s2", "s1"),  # named and within the window
        (2, ts(59), "s1", None),  # named but too far back: s3 is searched
        (3, ts(35), "gone", "lost"),  # none named, none near
        (4, None, "gone", "s2"),  # no time: the second path
        (5, ts(5), None, None),  # before all
        (6, None, None, None),
    ], "rec long, ref_ts string, path string, path_before string", "ref_ts")
    tol = spark.createDataFrame([("HR", 1.0)], "vital string, tol double")
    chosen, found = V.run(records, cells, snapshots, truth, None, tol)
    got = {r.rec: (r.source, r.snap, r.dt_s, r.missing) for r in chosen.collect()}
    assert got == {
        0: ("cache_dir_search", "s1", 12.0, 0), 1: ("explicit_snapshot", "s2", 1.0, 0), 2: ("cache_dir_search", "s3", 9.0, 0), 3: ("skipped", None, None, 2),
        4: ("explicit_snapshot", "s2", 0.0, 1), 5: ("skipped", None, None, 0), 6: ("skipped", None, None, 0),
    }
    assert {r.rec: (r.match, r.mismatch) for r in found.collect()} == {0: (True, False), 1: (False, True), 2: (False, True), 4: (False, True)}
    cache = spark.createDataFrame([("b", "HR", 61.0), ("b", "RR", 5.0)], "bed string, vital string, truth double")
    chosen, found = V.run(records, cells, snapshots, truth, cache, tol, V.Settings(nearest_past=True))
    got = {r.rec: (r.source, r.snap, r.nearest_used, r.dt_skipped) for r in chosen.collect()}
    assert got[3] == ("cache_dir_search", "s2", True, None) and got[5] == ("monitor_cache_fallback", None, False, "truth_dt_none") and got[6][3] == "ocr_dt_none+truth_dt_none"
    m = V.metrics(chosen, found).first()
    assert (m.total, m.fallback_used, m.nearest_fallback_used, m.dt_skipped) == (9, 3, 1, 2) and m.dt_skip_reason_counts == '{"ocr_dt_none+truth_dt_none":1,"truth_dt_none":1}'
    assert len(m) == 22
    # The cache's own time counts, where its document has one.
    chosen, _ = V.run(records, cells, snapshots, truth, as_time([("b", "HR", 61.0, ts(1))], "bed string, vital string, truth double, event_ts string", "event_ts"), tol)
    got = {r.rec: (r.source, r.dt_s, r.dt_skipped) for r in chosen.collect()}
    assert got[5] == ("monitor_cache_fallback", 4.0, None) and got[6] == ("monitor_cache_fallback", None, "ocr_dt_none")


def _validator_case(spark, seed):
    import random

    rng = random.Random(seed)
    t = "timestamp_ntz"
    stamp = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    as_time = lambda rows, schema, *cols: spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast(t) for c in cols})
    snaps = [f"s{k}" for k in range(12)]
    snapshots = as_time([(s, stamp(rng.randint(20, 80)), rng.choice([None, stamp(50)]), rng.random() > 0.25) for s in snaps], "snap string, snapshot_ts string, event_ts string, loaded boolean", "snapshot_ts", "event_ts")
    truth = spark.createDataFrame([(s, "b", v, float(rng.randint(0, 4))) for s in snaps for v in ("HR", "RR", "NO") if rng.random() > 0.1], "snap string, bed string, vital string, truth double")
    records = as_time([(r, rng.choice([None, *[stamp(rng.randint(15, 90))] * 9]), rng.choice([None, "lost", *snaps]), rng.choice([None, "lost", *snaps])) for r in range(15)], "rec long, ref_ts string, path string, path_before string", "ref_ts")
    cells = spark.createDataFrame([(r, "b", v, None, str(rng.randint(0, 4))) for r in range(15) for v in ("HR", "RR", "NO") if rng.random() > 0.1], "rec long, bed string, vital string, text string, value string")
    cache = spark.createDataFrame([("b", "HR", 2.0)], "bed string, vital string, truth double")
    return records, cells, snapshots, truth, cache, spark.createDataFrame([("HR", 1.0)], "vital string, tol double")


@pytest.mark.parametrize(("seed", "settings"), [
    (1, {"lookback_s": 5.0, "most": 2, "nearest_past": True}), (2, {"lookback_s": 8.0, "most": 0, "prefer_auto": True}), (3, {"lookback_s": 0.0, "most": 1, "nearest_past": True, "score_fields": ("HR", "NO")}),
])
def test_auto_lag_equals_a_run_at_each_lag(spark, seed, settings):
    from wardline.operators import lags as L
    from wardline.operators import validation as V

    records, cells, snapshots, truth, cache, tol = _validator_case(spark, seed)
    cache = cache if seed == 1 else None
    grid = (-9.0, -2.5, 0.0, 3.0, 10.0)
    got = L.auto_lag(records, cells, snapshots, truth, cache, tol, grid, V.Settings(**settings)).collect()
    want = []
    for lag in grid:
        _, found = V.run(records, cells, snapshots, truth, cache, tol, V.Settings(**settings, lag_s=lag))
        n, m, e = found.where("scored").agg(F.count("*"), F.count_if("match"), F.avg("abs_error")).first()
        want.append((lag, n, m, round(m / n if n else 0.0, 9), round(e or 0.0, 9)))
    assert [(r.lag_s, r.total, r.matched, round(r.match_rate, 9), round(r.mean_abs_error, 9)) for r in sorted(got, key=lambda r: r.lag_s)] == want
    assert [r.lag_s for r in got if r.best] == [min(want, key=lambda w: (-w[3], w[4], w[0]))[0]]


def test_compatibility_forms_of_every_character(spark):
    import sys
    import unicodedata

    chars = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    wanted = {c: f for c in chars if (f := "".join(x for x in unicodedata.normalize("NFKC", c) if x in R.PLAIN))}
    assert len(wanted) > 300 and max(map(len, wanted.values())) > 2
    others = [c for c in chars if c not in wanted][::97]
    rows = [(c, f"{c}7{c}") for c in [*wanted, *others]]
    keep = lambda t: "".join(x for x in unicodedata.normalize("NFKC", t) if x in "0123456789.-")
    for r in spark.createDataFrame(rows, "c string, t string").select("t", F.regexp_replace(R.folded(F.col("t")), r"[^0-9.\-/]", "").alias("f")).collect():
        assert r.f == "".join(x for x in unicodedata.normalize("NFKC", r.t) if x in R.PLAIN), ascii(r.t)
    got = spark.createDataFrame([("３⒇ ½.…",)], "t string").select(R.normalized(F.lit("CVP_M"), F.col("t")).alias("n")).first().n
    first, *rest = keep("３⒇½.…").split(".")
    assert got == first + "." + "".join(rest)
