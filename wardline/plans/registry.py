"""Queries over the shared tables, by name, and the SQL each must agree with.

``events`` stands for vitals: user is the bed, type the vital, event_id the order of arrival. Odd
events are truth, even ones are readings of it with an error that is a rule of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reading_text as R
from ..functions import scalars as S
from ..operators import asof, continuity, engines, geometry, lags, latest, messages, quantiles, readings, scan, validate, validation

FLAGSHIP = "match_metrics"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOOKBACK = 1800


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 2 = 1").select(F.col("event_id").alias("truth_id"), F.col("ts").alias("truth_ts"), F.col("event_type").alias("vital"), F.col("value").alias("truth"))


def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    value = F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") + (F.col("event_id") % 7) / 10, 2))
    return e.select(F.col("event_id").alias("_left"), F.col("ts").alias("read_ts"), F.col("event_type").alias("vital"), F.col("user_id").alias("bed"), value.alias("observed"))


TRUTH = "truth as (select event_id truth_id, ts truth_ts, event_type vital, value truth from events where event_id % 2 = 1)"
READ = "obs as (select event_id, ts read_ts, event_type vital, user_id bed, case when event_id % 11 <> 0 then round(value + (event_id % 7) / 10.0, 2) end observed from events where event_id % 2 = 0)"
PAIRS = f"""pairs as (select *, abs(observed - truth) abs_error, coalesce(abs(observed - truth) <= 50.0, false) "match",
  round(epoch_us(read_ts) - epoch_us(truth_ts)) / 1e6 dt from obs join truth using (vital) where truth_ts between read_ts - interval {LOOKBACK} second and read_ts)"""
BEST = "best as (select * from pairs qualify row_number() over (partition by event_id order by \"match\" desc, coalesce(abs_error, 'infinity'::double), dt, truth_ts desc) = 1)"
METRICS = """count(*) total, count(*) filter ("match") matched, count(*) filter (observed is null) missing,
  round(coalesce(count(*) filter ("match") / count(*), 0.0), 6) match_rate, round(coalesce(avg(abs_error), 0.0), 6) mean_abs_error,
  round(coalesce(median(abs_error), 0.0), 6) median_abs_error, round(coalesce(quantile_cont(abs_error, 0.9), 0.0), 6) p90_abs_error"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen truth of each reading. A pair that matches has a smaller error than one that does not, so the nearest in value, then in time, is the choice."""
    pairs = asof.closest(read_rows(spark, sf_dir), truth_rows(spark, sf_dir), "read_ts", "truth_ts", LOOKBACK, ["vital"], "observed", "truth", [F.asc("truth_id")])
    return validate.compare(pairs.withColumn("dt", S.seconds_between(F.col("read_ts"), F.col("truth_ts"))).withColumn("tol", F.lit(50.0)))


@query(f"with {TRUTH}, {READ}, {PAIRS}, {BEST} select vital, {METRICS} from best group by vital")
def match_metrics(spark, d):
    return validate.metrics(best(spark, d), ["vital"])


@query(f"with {TRUTH}, {READ}, {PAIRS}, {BEST} select {METRICS} from best")
def match_metrics_overall(spark, d):
    return validate.metrics(best(spark, d))


@query(f"with {TRUTH}, {READ}, {PAIRS}, {BEST} select event_id, truth_id, \"match\" matched, round(abs_error, 6) abs_error, round(dt, 6) dt from best")
def best_candidate(spark, d):
    return best(spark, d).select(F.col("_left").alias("event_id"), "truth_id", F.col("match").alias("matched"), F.round("abs_error", 6).alias("abs_error"), F.round("dt", 6).alias("dt"))


@query(f"with {TRUTH}, {READ}, {PAIRS} select event_id, truth_id, round(dt, 6) dt from pairs qualify row_number() over (partition by event_id order by truth_ts desc, truth_id desc) <= 3")
def range_join_lookback(spark, d):
    pairs = asof.range_join(read_rows(spark, d), truth_rows(spark, d), "read_ts", "truth_ts", LOOKBACK, ["vital"], 3, [F.desc("truth_id")])
    return pairs.select(F.col("_left").alias("event_id"), "truth_id", F.round(S.seconds_between(F.col("read_ts"), F.col("truth_ts")), 6).alias("dt"))


@query(f"with {TRUTH}, {READ}, {PAIRS}, {BEST} select round(avg(dt), 6) mean_dt, round(median(dt), 6) median_dt, round(quantile_cont(dt, 0.9), 6) p90_dt, count(*) evaluated, (select count(*) from obs) - count(*) skipped from best")
def dt_stats(spark, d):
    b = best(spark, d)
    n = read_rows(spark, d).agg(F.count("*").alias("n"))
    r = lambda c: F.round(c, 6)
    stats = quantiles.with_quantiles(b.agg(r(F.avg("dt")).alias("mean_dt"), F.count("*").alias("evaluated")), b, "dt", {"median": 0.5, "p90": 0.9})
    return stats.crossJoin(n).select("mean_dt", r(F.col("median")).alias("median_dt"), r(F.col("p90")).alias("p90_dt"), "evaluated", (F.col("n") - F.col("evaluated")).alias("skipped"))  # one row each


@query("with o as (select *, case when event_id % 11 = 0 then (case when event_id % 2 = 0 then '' else '--' end) end as text from events) select case when text is null then 'valid' when trim(text) = '' then 'empty' else 'invalid_numeric:' || text end reason, count(*) n from o group by 1")
def skip_reasons(spark, d):
    e = table(spark, d, "events").withColumn("text", F.when(F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 2 == 0, "").otherwise("--")).otherwise(F.col("value").cast("string")))
    value = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    return e.groupBy(F.coalesce(S.invalid_reason(F.col("text"), value), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {TRUTH}, {READ}, lags as (select unnest([-600.0, -300.0, 0.0, 300.0, 600.0])::double lag_s),
  shifted as (select event_id, vital, observed, lag_s, read_ts + to_microseconds((lag_s * 1000000)::bigint) read_ts from obs, lags),
  hit as (select s.*, t.truth, t.truth_ts from shifted s asof left join truth t on s.vital = t.vital and s.read_ts >= t.truth_ts)
  select lag_s, count(*) total, count(*) filter (abs(observed - truth) <= 50.0) matched, round(avg(abs(observed - truth)), 6) mean_abs_error from hit group by 1""")
def lag_grid(spark, d):
    few_lags = spark.createDataFrame([(float(x),) for x in (-600, -300, 0, 300, 600)], "lag_s double")
    hit = asof.asof(validate.lag_grid(read_rows(spark, d), few_lags, "read_ts"), truth_rows(spark, d), "read_ts", "truth_ts", ["vital"])
    error = F.abs(F.col("observed") - F.col("truth"))
    return hit.groupBy("lag_s").agg(F.count("*").alias("total"), F.count_if(error <= 50.0).alias("matched"), F.round(F.avg(error), 6).alias("mean_abs_error"))


@query(f"with {TRUTH}, {READ}, {PAIRS}, {BEST} select event_id, vital, observed, truth, round(abs_error, 6) abs_error from best order by abs_error desc nulls first, event_id limit 25")
def worst_mismatches(spark, d):
    return validate.worst(best(spark, d), 25, "_left").select(F.col("_left").alias("event_id"), "vital", "observed", "truth", F.round("abs_error", 6).alias("abs_error"))


@query(f"with {TRUTH}, {READ} select o.event_id, t.truth_id, t.truth from obs o asof left join truth t on o.vital = t.vital and o.read_ts >= t.truth_ts")
def asof_backward(spark, d):
    return asof.asof(read_rows(spark, d), truth_rows(spark, d), "read_ts", "truth_ts", ["vital"]).select(F.col("_left").alias("event_id"), "truth_id", "truth")


@query(f"with {TRUTH}, {READ}, r as (select truth_ts, max(truth_id) truth_id from truth group by truth_ts) select o.event_id, r.truth_id from obs o asof left join r on o.read_ts >= r.truth_ts")
def asof_keyless(spark, d):
    right = truth_rows(spark, d).groupBy("truth_ts").agg(F.max("truth_id").alias("truth_id"))
    return asof.asof(read_rows(spark, d).select(F.col("_left").alias("event_id"), "read_ts"), right, "read_ts", "truth_ts").select("event_id", "truth_id")


@query(f"""with {TRUTH}, {READ}, p as (select o.event_id, o.vital, o.read_ts, t.truth_id p_id, t.truth_ts p_ts from obs o asof left join truth t on o.vital = t.vital and o.read_ts >= t.truth_ts),
  n as (select p.*, t.truth_id n_id, t.truth_ts n_ts from p asof left join truth t on p.vital = t.vital and p.read_ts <= t.truth_ts),
  c as (select *, epoch_us(read_ts) - epoch_us(p_ts) back, epoch_us(n_ts) - epoch_us(read_ts) ahead from n),
  u as (select *, coalesce(ahead < back, back is null) and (back is null or ahead <= 900000000) use_next from c)
  select event_id, case when use_next then n_id else p_id end truth_id, round(case when use_next then ahead else -back end / 1e6, 6) delta_s from u""")
def asof_nearest(spark, d):
    hit = asof.nearest(read_rows(spark, d), truth_rows(spark, d), "read_ts", "truth_ts", 900, ["vital"])
    return hit.select(F.col("_left").alias("event_id"), "truth_id", F.round("delta_s", 6).alias("delta_s"))


@query("select user_id, max(event_id) event_id, arg_max(ts, event_id) ts, arg_max(event_type, event_id) event_type, arg_max(value, event_id) value, arg_max(props, event_id) props from events group by user_id")
def latest_bed(spark, d):
    return latest.latest(table(spark, d, "events").withColumn("_seq", F.col("event_id")), ["user_id"], "_seq").drop("_seq")


@query("select user_id, event_type, max(event_id) event_id, arg_max(ts, event_id) ts, arg_max(value, event_id) value from events group by all")
def latest_bed_vital(spark, d):
    return latest.latest(table(spark, d, "events").drop("props").withColumn("_seq", F.col("event_id")), ["user_id", "event_type"], "_seq").drop("_seq")


@query("select event_type, count(*) n, count(*) filter (value is null or event_id % 11 = 0) missing from events group by event_type")
def running_missing(spark, d):
    return latest.running_missing(table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value"))), "event_type", "value")


@query("""with f as (select event_type, (epoch_us(ts) // 10000000)::bigint frame, count(*) n, count(*) filter (value is null or event_id % 11 = 0) missing from events group by all)
  select event_type, frame, n, missing, (sum(n) over w)::bigint n_so_far, (sum(missing) over w)::bigint missing_so_far from f window w as (partition by event_type order by frame)""")
def running_missing_frames(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    e = e.withColumn("frame", F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 10_000_000).cast("long"))
    return latest.running_missing_at(e, "event_type", "frame", "value", scan.width(e, ["event_type"], "frame"))


@query("""select event_id, user_id, count(*) over w nth, count(*) filter (event_id % 11 = 0) over w missing_so_far, (sum(value) over w)::decimal(18,2)::double value_so_far, max(value) over w most, arg_max(case when event_id % 3 = 0 then event_type end, case when event_id % 3 = 0 then event_id end) over (w rows between unbounded preceding and 1 preceding) last_third
  from events window w as (partition by event_type order by event_id)""")
def running_rows(spark, d):
    """Counts, sums, greatest and last values along each type's events: few keys, each cut into many parts."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    i = F.col("event_id")
    ran = scan.scan(
        e, ["event_type"], ["event_id"], scan.width(e, ["event_type"], "event_id"), nth=scan.total(F.lit(1)), missing_so_far=scan.total((i % 11 == 0).cast("int")),
        value_so_far=scan.total(F.col("value").cast("decimal(18,2)")), most=scan.most(F.col("value")), last_third=scan.latest(F.when(i % 3 == 0, F.col("event_type")), upto=False),
    )
    return ran.select("event_id", "user_id", "nth", "missing_so_far", F.col("value_so_far").cast("double").alias("value_so_far"), "most", "last_third")


@query("""with m as (select user_id, ts::date as dd, event_type, arg_max(value, event_id) v from events group by all),
  s as (select user_id, ts::date as dd, max(date_trunc('second', ts)) sent from events group by all)
  select m.user_id::varchar bed_id, strftime(dd, '%Y%m%d') as "day", event_type vital, v "value", s.sent message_time from m join s using (user_id, dd)""")
def hl7_roundtrip(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    built = messages.build(e, ["user_id", "day"], "user_id", "user_id", "ts", "event_type", "value", "event_id")
    parsed = messages.observations(messages.parse(built, "message"))
    return parsed.select("bed_id", "day", "vital", "value", "message_time")


@query("select o_orderkey, date_trunc('second', o_orderdate) + to_minutes((o_orderkey % 1440)::bigint) full_time, date_trunc('day', o_orderdate) day_only, null::timestamp as bad from orders")
def hl7_datetime(spark, d):
    o = table(spark, d, "orders")
    at = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.col("o_orderdate"))
    stamp = F.date_format(at, "yyyyMMddHHmm")
    return o.select("o_orderkey", S.message_time(F.concat(stamp, F.lit("00+0900"))).alias("full_time"), S.message_time(F.date_format("o_orderdate", "yyyyMMdd")).alias("day_only"), S.message_time(F.concat(F.substring(stamp, 1, 4), F.lit("0230"))).alias("bad"))


@query("select l_orderkey, l_linenumber, l_extendedprice cleaned, (l_quantity::bigint::varchar || l_linenumber::varchar)::double joined, null::double as bad, l_extendedprice first_found from lineitem")
def numeric_clean(spark, d):
    line = table(spark, d, "lineitem")
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_quantity").cast("bigint").cast("string")
    return line.select(
        "l_orderkey", "l_linenumber", S.clean_number(F.concat(F.lit("> "), price, F.lit(" mmHg"))).alias("cleaned"), S.clean_number(F.concat(quantity, F.lit("/"), F.col("l_linenumber").cast("string"))).alias("joined"),
        S.clean_number(F.concat(quantity, F.lit("-"), quantity)).alias("bad"), S.first_number(F.concat(F.lit("about "), price, F.lit(" or 7"))).alias("first_found"),
    )


ENGINES = f"""eng as (select event_id, event_type field, value truth, case when event_id % 5 <> 0 then round(value + (event_id % 3) / 10.0, 2) end easy_value, case when event_id % 7 <> 0 then round(value + (event_id % 4) / 10.0, 2) end tess_value from events),
  cmp as (select *, abs(easy_value - truth) easy_abs_err, abs(tess_value - truth) tess_abs_err, coalesce(abs(easy_value - truth) <= 0.15, false) easy_match, coalesce(abs(tess_value - truth) <= 0.15, false) tess_match,
  case when easy_value is null and tess_value is null then 'none' when tess_value is null or abs(easy_value - truth) < abs(tess_value - truth) then 'easy' when easy_value is null or abs(tess_value - truth) < abs(easy_value - truth) then 'tess' else 'tie' end winner from eng)"""


def engine_rows(spark, d):
    e = table(spark, d, "events")
    v = lambda skip, mod: F.when(F.col("event_id") % skip != 0, F.round(F.col("value") + (F.col("event_id") % mod) / 10, 2))
    return engines.compared(e.select("event_id", F.col("event_type").alias("field"), F.col("value").alias("truth"), v(5, 3).alias("easy_value"), v(7, 4).alias("tess_value"), F.lit(0.15).alias("tol")))


@query(f"""with {ENGINES} select field, count(*) n, count(*) filter (winner = 'easy') easy_win, count(*) filter (winner = 'tess') tess_win, count(*) filter (winner = 'tie') tie, count(*) filter (winner = 'none') both_bad,
  round((count(*) filter (easy_match) + count(*) filter (tess_match)) / (2 * count(*)), 4) match_rate,
  round(avg(easy_abs_err), 4) easy_mae, round(count(*) filter (easy_match) / count(*), 4) easy_match_rate,
  round(count(*) filter (easy_value is null and event_id % 2 = 0) / count(*), 4) easy_missing_rate, round(count(*) filter (easy_value is null and event_id % 2 <> 0) / count(*), 4) easy_invalid_rate,
  round(avg(tess_abs_err), 4) tess_mae, round(count(*) filter (tess_match) / count(*), 4) tess_match_rate,
  round(count(*) filter (tess_value is null and event_id % 3 = 0) / count(*), 4) tess_missing_rate, round(count(*) filter (tess_value is null and event_id % 3 <> 0) / count(*), 4) tess_invalid_rate,
  round(avg(case when winner = 'tess' then tess_abs_err else easy_abs_err end), 4) winner_mae, round(median(case when winner = 'tess' then tess_abs_err else easy_abs_err end), 4) winner_median
  from cmp group by grouping sets ((field), ())""")
def engine_compare(spark, d):
    i = F.col("event_id")
    rows = engine_rows(spark, d).withColumns({"easy_text": F.when(i % 2 == 0, "").otherwise("--"), "tess_text": F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise("?")})
    return engines.summary(rows, digits=4)


@query(f"with {ENGINES} select event_id, field, winner, round(easy_abs_err, 6) easy_abs_err, round(tess_abs_err, 6) tess_abs_err from cmp")
def winloss(spark, d):
    return engine_rows(spark, d).select("event_id", "field", "winner", F.round("easy_abs_err", 6).alias("easy_abs_err"), F.round("tess_abs_err", 6).alias("tess_abs_err"))


@query("""with s as (select l_quantity::bigint::varchar a, (l_quantity::bigint + l_linenumber * 9)::varchar b from lineitem), p as (select a, b, unnest(range(1, greatest(length(a), length(b)) + 1)) i from s)
  select coalesce(nullif(substring(a, i, 1), ''), '_') truth_digit, coalesce(nullif(substring(b, i, 1), ''), '_') pred_digit, count(*) "count" from p group by 1, 2""")
def digit_confusion(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_quantity").alias("truth"), F.concat((F.col("l_quantity").cast("bigint") + F.col("l_linenumber") * 9).cast("string"), F.lit(" mL")).alias("read"))
    return engines.digit_confusion(line)


PRIOR = "last_value(v ignore nulls) over (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding)"
GAPPY = "g as (select event_id, user_id, event_type, ts, case when event_id % 4 <> 0 then value end v from events)"


def gappy(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))


@query(f"with {GAPPY} select event_id, {PRIOR} prior from g")
def prior_confirmed(spark, d):
    return readings.prior_confirmed(gappy(spark, d), ["user_id", "event_type"], "event_id", "v").select("event_id", "prior")


@query(f"with {GAPPY}, p as (select *, {PRIOR} prior from g) select event_id, case when event_type = 'error' then v else coalesce(v, prior) end held, v is null and prior is not null and event_type <> 'error' imputed from p")
def hold_last(spark, d):
    return readings.hold_last(gappy(spark, d), ["user_id", "event_type"], "event_id", "v", F.col("event_type") == "error").select("event_id", "held", "imputed")


@query(f"""with {GAPPY}, p as (select *, {PRIOR} prior from g) select event_id, round(case when v is null or prior is null then 0.0 when abs(v - prior) / greatest(abs(prior), 1.0) <= 0.03 then 0.25
  when abs(v - prior) / greatest(abs(prior), 1.0) <= 0.10 then 0.15 when abs(v - prior) / greatest(abs(prior), 1.0) <= 0.30 then 0.05 else -0.10 end::double, 6) bonus from p""")
def continuity_score(spark, d):
    p = readings.prior_confirmed(gappy(spark, d), ["user_id", "event_type"], "event_id", "v")
    return p.select("event_id", F.round(readings.continuity_bonus(F.col("v"), F.col("prior")), 6).alias("bonus"))


def _bonus(v: str) -> str:
    r = f"abs({v} - state) / greatest(abs(state), 1.0)"
    return f"case when {v} is null or state is null then 0.0 when {r} <= 0.03 then 0.25 when {r} <= 0.10 then 0.15 when {r} <= 0.30 then 0.05 else -0.10 end::double"


def _chosen(source: str) -> str:
    scored = f"(select *, b0 + {_bonus('v0')} s0, b1 + {_bonus('v1')} s1, b2::double s2 from ({source}))"
    picked = f"(select *, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end choice from {scored})"
    return f"select bed, event_type, n, event_id, choice, state prior, case choice when 0 then v0 when 1 then v1 end \"value\", coalesce(case choice when 0 then v0 when 1 then v1 end, state) state from {picked}"


@query(f"""with recursive f as (select (user_id % 6)::bigint bed, event_type, event_id, row_number() over (partition by user_id % 6, event_type order by event_id) n, case when event_id % 4 <> 0 then value end v0, value * 10 v1,
    0.5::double + (event_id * 7 % 50) / 100::double b0, 0.5::double + (event_id * 13 % 50) / 100::double b1, 0.4::double + (event_id * 29 % 60) / 100::double b2 from events),
  run as ({_chosen('select *, null::double state from f where n = 1')} union all {_chosen('select f.*, run.state from run join f on f.bed = run.bed and f.event_type = run.event_type and f.n = run.n + 1')})
  select event_id, bed, event_type, choice, "value", prior, state held, "value" is null and prior is not null imputed from run""")
def recursive_continuity(spark, d):
    """Three candidates an event (the reading, or none on every fourth; ten times it; no number), each choice the prior of the next."""
    i = F.col("event_id")
    c = lambda value, low, by, of: F.struct(value.alias("value"), (F.lit(low) + (i * by % of) / 100).alias("base"))
    candidates = F.array(c(F.when(i % 4 != 0, F.col("value")), 0.5, 7, 50), c(F.col("value") * 10, 0.5, 13, 50), c(F.lit(None).cast("double"), 0.4, 29, 60))
    frames = table(spark, d, "events").select((F.col("user_id") % 6).alias("bed"), "event_type", "event_id", candidates.alias("candidates"))
    return continuity.choose(frames, ["bed", "event_type"], "event_id", step=scan.width(frames, ["bed", "event_type"], "event_id", continuity.STEP))


@query("""with c as (select l_orderkey, l_linenumber, l_quantity q, l_discount conf, l_quantity::bigint::varchar t, l_linenumber % 2 = 0 ok from lineitem),
  s as (select *, 1.5 * conf + case when ok then 0.8 else -0.4 end + 0.08 * least(length(t), 4) + 0.2 score from c)
  select l_orderkey, l_linenumber, q, round(score, 6) score from s qualify row_number() over (partition by l_orderkey order by round(score, 6) desc, l_linenumber, q) = 1""")
def candidate_argmax(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), "l_discount", F.col("l_quantity").cast("bigint").cast("string").alias("t"))
    score = readings.candidate_score(F.col("l_discount"), F.col("t"), F.col("l_linenumber") % 2 == 0, F.col("q"), F.lit(None).cast("double"))
    c = c.withColumn("score", F.round(score, 6)).withColumn("place", F.col("l_linenumber") * 1000 + F.col("q"))
    return readings.best_scored(c, ["l_orderkey"], "score", "place").select("l_orderkey", "l_linenumber", "q", "score")


@query("select event_id, event_type is distinct from lag(event_type) over w or lag(event_type) over w is null changed from events window w as (partition by user_id order by event_id)")
def stamp_change(spark, d):
    return readings.changes(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("event_id", "changed")


@query("""with x as (select distinct user_id, floor(epoch(ts) / 3600)::bigint h from events), r as (select *, h - row_number() over (partition by user_id order by h) g from x)
  select user_id, min(h) first_index, max(h) last_index, count(*) length, round(avg(h), 6) centre from r group by user_id, g""")
def gaps_islands(spark, d):
    hours = table(spark, d, "events").select("user_id", F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 3600).cast("long").alias("h")).distinct()
    return readings.islands(hours, ["user_id"], "h")


@query("select event_id, ts, user_id from (select *, row_number() over (partition by date_trunc('hour', ts) order by user_id, event_id) n from events where event_type = 'error') where n <= 2")
def capped_failures(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("tick", F.date_trunc("hour", F.col("ts")))
    return readings.capped(e, ["tick"], ["user_id", "event_id"], 2).select("event_id", "ts", "user_id")


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) i from lineitem)
  select l_orderkey, i, max(v - i) over (partition by l_orderkey order by i) + i fixed from p""")
def strictly_rising(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("v"))
    fixed = readings.strictly_rising(p, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "v")
    return fixed.select("l_orderkey", F.col("nth").alias("i"), "fixed")


@query("select user_id, max(ts) ts, max(ts) < timestamp '2024-01-30' stale from events group by user_id")
def staleness(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.withColumn("stale", readings.stale(F.col("ts"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 0))


GRID_SQL = ", ".join(f"('{v}', {i})" for i, v in enumerate("HR ART_S ART_D ART_M CVP_M RAP_M SpO2 TSKIN TRECT rRESP EtCO2 RR VTe VTi Ppeak PEEP O2conc NO BSR1 BSR2".split()))


@query(f"""with v(vital, vi) as (values {GRID_SQL}), b as (select 'BED0' || (i + 1)::varchar bed, i bi from range(6) t(i))
  select bed, vital, (vi // 4)::bigint "row", (vi % 4)::int col, ((bi % 2) * 960 + (vi % 4) * 240)::bigint x1, ((bi // 2) * 340 + 60 + (vi // 4) * 68)::bigint y1, ((bi % 2) * 960 + (vi % 4) * 240 + 240)::bigint x2, ((bi // 2) * 340 + 60 + (vi // 4) * 68 + 68)::bigint y2 from b, v""")
def grid_geometry(spark, d):
    g = geometry.grid(spark, 1920, 1080, 60)
    return g.select("bed", "vital", F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""with t(idx, l, t, w, h) as (values (0, 0, 0, 20, 5), (1, 30, 2, 10, 3), (2, 10, 1, 40, 7)), b as (select p_partkey box, p_size a, p_partkey % 9 b, p_partkey % 31 c, p_partkey % 13 e from part),
  x as (select box, idx, abs(a - l) + abs(b - t) + abs(c - w) + abs(e - h) dist from b, t) select box, (arg_min(idx, dist * 10 + idx))::int idx, min(dist)::bigint distance from x group by box""")
def nearest_rectangle(spark, d):
    p = table(spark, d, "part")
    boxes = p.select(F.col("p_partkey").alias("box"), F.col("p_size").cast("long").alias("left"), (F.col("p_partkey") % 9).alias("top"), (F.col("p_partkey") % 31).alias("width"), (F.col("p_partkey") % 13).alias("height"))
    targets = spark.createDataFrame([(0, 0, 0, 20, 5), (1, 30, 2, 10, 3), (2, 10, 1, 40, 7)], "idx int, left long, top long, width long, height long")
    return geometry.nearest_rectangle(boxes, targets)


@query("select event_id, 'k' as name, json_extract_string(props, '$.k')::double num from events")
def json_flatten(spark, d):
    e = table(spark, d, "events").withColumn("j", F.try_parse_json("props"))
    return e.select("event_id", "j").lateralJoin(spark.tvf.variant_explode(F.col("j").outer())).select("event_id", F.col("key").alias("name"), F.try_variant_get("value", "$", "double").alias("num"))


@query("""with c as (select doc_id, regexp_extract(replace(text, ',', ''), '[-+]?\\d+(?:\\.\\d+)?') t from documents) select doc_id, try_cast(nullif(t, '') as double) first_found from c""")
def text_first_number(spark, d):
    return table(spark, d, "documents").select("doc_id", S.first_number(F.col("text")).alias("first_found"))


@query("""with r as (select event_id, case event_id % 4 when 0 then 'HR' when 1 then 'TSKIN' when 2 then 'SpO2' else 'VTi' end vital, event_id % 4 k, floor(value)::bigint n from events),
  t as (select *, case when k = 1 then (300 + n % 150) else n end raw from r), v as (select *, case when k = 1 then raw / 10.0 else raw::double end x from t)
  select event_id, vital, case when (k = 0 and x between 30 and 250) or (k = 1 and x between 30 and 45) or (k = 2 and x between 30 and 100) or (k = 3 and x between 0 and 2000) then round(x, 6) end parsed from v""")
def reading_text(spark, d):
    e = table(spark, d, "events")
    k, n = F.col("event_id") % 4, F.floor("value").cast("long")
    vital = F.when(k == 0, "HR").when(k == 1, "TSKIN").when(k == 2, "SpO2").otherwise("VTi")
    raw = F.when(k == 1, 300 + n % 150).otherwise(n).cast("string")
    text = F.concat(F.lit("~"), F.translate(raw, R.PLAIN[:10], R.FULL_WIDTH[:10]), F.lit(" x"))
    rows = e.select("event_id", vital.alias("vital"), text.alias("text"))
    return rows.select("event_id", "vital", F.round(R.parsed_number(F.col("vital"), R.normalized(F.col("vital"), F.col("text"))), 6).alias("parsed"))


@query("""with v as (select event_id, case event_id % 3 when 0 then 'HR' when 1 then 'TSKIN' else 'TRECT' end vital, case when event_id % 11 <> 0 then value end x from events)
  select event_id, vital, case when x is null then '....' when vital = 'HR' then round_even(x, 0)::bigint::varchar else printf('%.1f', x) end shown from v""")
def display_value(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(i % 3 == 0, "HR").when(i % 3 == 1, "TSKIN").otherwise("TRECT").alias("vital"), F.when(i % 11 != 0, F.col("value")).alias("x"))
    return e.select("event_id", "vital", S.display_value(F.col("vital"), F.col("x")).alias("shown"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)")
def anti_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("select c_custkey, coalesce(n_name, 'unknown') nation from customer left join nation on c_nationkey = n_nationkey + 5")
def dim_lookup(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 5).alias("c_nationkey"), "n_name")  # the least keys have none
    return table(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("select event_id, ts, value from events order by event_id desc limit 50")
def last_n(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(50).select("event_id", "ts", "value")


@query("with o as (select o_custkey k, 'order' source from orders union all select c_custkey, 'customer' from customer) select k, case when count(*) filter (source = 'order') > 0 then 'order' else 'customer' end source from o group by k")
def union_priority(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("p"), F.lit("customer").alias("source"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("p"), F.lit("order").alias("source"))
    return a.unionByName(b).groupBy("k").agg(F.min_by("source", "p").alias("source"))


@query("select time_bucket(interval 1 hour, ts) start, event_type, count(*) n, round(avg(value), 6) mean from events group by 1, 2")
def tumbling_window(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts) k from g)
  select user_id, min(ts) start, count(*) n from s group by user_id, k""")
def session_window(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


@query("""select event_id, case when event_id % 3 = 0 and event_id % 5 = 0 then 'cache_dir_search' when event_id % 3 = 0 then 'explicit_snapshot' when event_id % 5 = 0 then 'cache_dir_search' when event_id % 7 = 0 then 'monitor_cache_fallback' else 'skipped' end source from events""")
def truth_source(spark, d):
    i = F.col("event_id")
    source = validate.truth_source(i % 3 == 0, F.lit(True), i % 5 == 0, i % 7 == 0)
    return table(spark, d, "events").select("event_id", source.alias("source"))


def validator_sql(lookback_s: int = 10_800, most: int = 2, early: bool = False, unread: bool = False, cache: bool = False, nearest: bool = False, prefer_auto: bool = False, lags: str = "values (0.0::double)") -> str:
    """Steps of a validator run: every record at every lag."""
    limit = f"qualify row_number() over (partition by rec, lag_s order by snapshot_ts desc) <= {most}" if most else ""
    past = f"union all select r.rec, r.lag_s, r.ref_ts, s.hr, s.snapshot_ts, s.ok, epoch_us(r.ref_ts) - epoch_us(s.snapshot_ts), true from (select * from rec anti join inside using (rec, lag_s) where ref_ts is not null) r asof join snap s on r.ref_ts >= s.snapshot_ts" if nearest else ""
    far = f"coalesce(abs(epoch_us(ref_ts) - epoch_us(explicit_ts)) > {lookback_s * 1_000_000}, false)"
    rest = "'monitor_cache_fallback'" if cache else "'skipped'"
    first = "when auto is not null then 'cache_dir_search' when explicit is not null then 'explicit_snapshot'" if prefer_auto else f"when explicit is not null and not ({far} and auto is not null) then 'explicit_snapshot' when auto is not null then 'cache_dir_search'"
    return f"""h as (select *, (epoch_us(ts) // 3600000000)::bigint rec, ((epoch_us(ts) - 1200000000) // 3600000000)::bigint seen, (user_id % 6)::varchar bed, event_type vital from events),
  truth as (select rec hr, bed, vital, arg_max(value, event_id) truth from h group by all), now as (select bed, vital, arg_max(value, event_id) truth from h group by all), now_at as (select max(ts) now_ts from h),
  snap as (select distinct hr, hr::varchar snap, make_timestamp(hr * 3600000000) + interval 5 minute snapshot_ts, {"hr % 13 <> 0" if unread else "true"} ok from truth),
  cells as (select rec, bed, vital, case when i % 13 = 0 then '--' when i % 17 = 0 then '' else v::decimal(18,2)::varchar end "text", case when i % 13 <> 0 and i % 17 <> 0 then v::decimal(18,2)::double end parsed
    from (select seen rec, bed, vital, max(event_id) i, arg_max(round(value + (event_id % 7) / 10.0, 2), event_id) v from h group by all)),
  lag(lag_s) as ({lags}),
  rec as (select rec, lag_s, case when rec % 11 <> 0 then make_timestamp(rec * 3600000000) + {"to_minutes(case when rec % 4 = 1 then 3 else 10 end)" if early else "interval 10 minute"} + to_microseconds((lag_s * 1000000)::bigint) end ref_ts,
    case rec % 3 when 0 then rec::varchar when 2 then 'missing' end path, case when rec % 5 = 0 then (rec - 7)::varchar end path_before from (select distinct rec from h), lag),
  tol(vital, tol) as (values ('click', 0.3), ('view', 0.5), ('error', 5.0)),
  inside as (select rec, lag_s, ref_ts, hr, snapshot_ts, ok, epoch_us(ref_ts) - epoch_us(snapshot_ts) delta, false nearest from rec join snap on snapshot_ts between ref_ts - interval {lookback_s} second and ref_ts {limit}),
  cand as (from inside {past}),
  pair as (select p.rec, p.hr, abs(c.parsed - t.truth) err, coalesce(abs(c.parsed - t.truth) <= coalesce(tol.tol, 0), false) ok from (select distinct rec, hr from cand where ok) p join truth t using (hr) left join cells c on c.rec = p.rec and c.bed = t.bed and c.vital = t.vital left join tol on tol.vital = t.vital),
  score as (select rec, hr, count(*) filter (ok) matched, coalesce(round(avg(err), 9), 'infinity'::double) mae from pair group by all),
  auto as (select rec, lag_s, hr auto, snapshot_ts auto_ts, nearest from cand join score using (rec, hr) where ok qualify row_number() over (partition by rec, lag_s order by matched desc, mae, delta) = 1),
  ex as (select r.*, case when a.ok then a.hr when b.ok then b.hr end explicit, case when a.ok then a.snapshot_ts when b.ok then b.snapshot_ts end explicit_ts, case when a.ok then 'path' when b.ok then 'path_before' end key,
    case when a.ok then 0 else (path is not null and a.hr is null)::int + (path_before is not null and b.hr is null)::int end missing, case when a.ok then 0 else coalesce((not a.ok)::int, 0) + coalesce((not b.ok)::int, 0) end load_errors
    from rec r left join snap a on a.snap = path left join snap b on b.snap = path_before),
  ch as (select *, case {first} else {rest} end source from ex left join auto using (rec, lag_s)),
  chosen as (select * replace (case when {str(prefer_auto).lower()} and auto is not null then null else key end as key, case when {str(prefer_auto).lower()} and auto is not null then 0 else missing end as missing, case when {str(prefer_auto).lower()} and auto is not null then 0 else load_errors end as load_errors),
    case source when 'explicit_snapshot' then explicit when 'cache_dir_search' then auto end hr, coalesce(nearest and source = 'cache_dir_search', false) nearest_used,
    case source when 'explicit_snapshot' then coalesce((epoch_us(ref_ts) - epoch_us(explicit_ts)) / 1e6, 0.0) when 'cache_dir_search' then (epoch_us(ref_ts) - epoch_us(auto_ts)) / 1e6 when 'monitor_cache_fallback' then (epoch_us(ref_ts) - epoch_us(now_ts)) / 1e6 end dt from ch, now_at),
  used as (select ch.rec, ch.lag_s, t.bed, t.vital, t.truth from chosen ch join truth t using (hr) union all select ch.rec, ch.lag_s, now.bed, now.vital, now.truth from chosen ch, now where source = 'monitor_cache_fallback'),
  item as (select u.*, c."text", c.parsed, abs(c.parsed - u.truth) err, coalesce(abs(c.parsed - u.truth) <= coalesce(tol.tol, 0), false) ok from used u left join cells c on c.rec = u.rec and c.bed = u.bed and c.vital = u.vital left join tol on tol.vital = u.vital)"""


VALIDATOR = validator_sql()
METRICS_SQL = """c as (select count(*) total, count(*) filter (ok) matched, avg(err) mae, median(err) med, count(*) filter (parsed is null) missing, count(*) filter (parsed is null) invalid from item),
  r as (select count(*) filter (key = 'path_before') snapshot_before_used, count(*) filter (key = 'path') snapshot_used, count(*) filter (source = 'explicit_snapshot') explicit_used, count(*) filter (source = 'cache_dir_search') auto_used,
    count(*) filter (source = 'monitor_cache_fallback' or nearest_used) fallback_used, sum(missing)::bigint snapshot_missing, sum(load_errors)::bigint snapshot_load_error, count(*) filter (source = 'skipped') skipped, count(*) filter (nearest_used) nearest_fallback_used,
    avg(abs(dt)) dm, median(abs(dt)) dd, quantile_cont(abs(dt), 0.9) dp, count(dt) dn, count(*) filter (source <> 'skipped' and dt is null) ds from chosen),
  w as (select case when ref_ts is null then 'ocr_dt_none' else 'truth_dt_none' end why, count(*) n from chosen where source <> 'skipped' and dt is null group by 1)
  select total, round(matched / total, 6) match_rate, round(mae, 6) mean_abs_error, round(med, 6) median_abs_error, round(missing / total, 6) missing_rate, round(invalid / total, 6) invalid_rate, snapshot_before_used, snapshot_used, explicit_used, auto_used,
    fallback_used, snapshot_missing, snapshot_load_error, skipped skipped_truth_unavailable, case when skipped > 0 then '{"truth_unavailable":' || skipped || '}' else '{}' end skip_reason_counts, nearest_fallback_used,
    round(dm, 6) dt_mean_seconds, round(dd, 6) dt_median_seconds, round(dp, 6) dt_p90_seconds, dn dt_evaluated, ds dt_skipped, '{' || coalesce((select string_agg('"' || why || '":' || n, ',' order by why) from w), '') || '}' dt_skip_reason_counts from c, r"""


def validator_tables(spark, d, early: bool = False, unread: bool = False):
    """Hours of events as snapshots of truth, and readings of the events from twenty minutes past each hour; records name their own hour, an hour too far back, one that is not there, or none.

    ``early``: each fourth record is from before its hour's snapshot. ``unread``: each thirteenth snapshot could not be read.
    """
    hour = lambda late: F.floor((F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) - late) / 3_600_000_000).cast("long")
    h = table(spark, d, "events").select("event_id", "ts", "value", hour(0).alias("rec"), hour(1_200_000_000).alias("seen"), (F.col("user_id") % 6).cast("string").alias("bed"), F.col("event_type").alias("vital"))
    at = lambda minutes: F.timestamp_add("MINUTE", (F.col("rec") * 60 + minutes).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    truth = h.groupBy(F.col("rec").cast("string").alias("snap"), "bed", "vital").agg(F.max_by("value", "event_id").alias("truth"))
    hours = h.select("rec").distinct()
    r = F.col("rec")
    snapshots = hours.select(r.cast("string").alias("snap"), at(5).alias("snapshot_ts"), F.lit(None).cast("timestamp_ntz").alias("event_ts"), (r % 13 != 0 if unread else F.lit(True)).alias("loaded"))
    v = F.round(F.col("value") + (F.col("event_id") % 7) / 10, 2)
    cells = h.groupBy(F.col("seen").alias("rec"), "bed", "vital").agg(F.max("event_id").alias("i"), F.max_by(v, "event_id").cast("decimal(18,2)").cast("string").alias("v"))
    bad = (F.col("i") % 13 == 0) | (F.col("i") % 17 == 0)
    cells = cells.select("rec", "bed", "vital", F.when(F.col("i") % 13 == 0, "--").when(F.col("i") % 17 == 0, "").otherwise(F.col("v")).alias("text"), F.when(~bad, F.col("v")).alias("value"))
    minute = F.when(r % 4 == 1, 3).otherwise(10) if early else F.lit(10)
    records = hours.select("rec", F.when(r % 11 != 0, at(minute)).alias("ref_ts"), F.when(r % 3 == 0, r.cast("string")).when(r % 3 == 2, "missing").alias("path"), F.when(r % 5 == 0, (r - 7).cast("string")).alias("path_before"))
    cache = h.groupBy("bed", "vital").agg(F.max_by("value", "event_id").alias("truth")).crossJoin(F.broadcast(h.agg(F.max("ts").alias("event_ts"))))  # one row
    tolerances = spark.createDataFrame([("click", 0.3), ("view", 0.5), ("error", 5.0)], "vital string, tol double")
    return records, cells, snapshots, truth, cache, tolerances


def validator_run(spark, d):
    records, cells, snapshots, truth, _, tolerances = validator_tables(spark, d)
    return validation.run(records, cells, snapshots, truth, None, tolerances, validation.Settings(lookback_s=10_800, most=2))


@query(f"with {VALIDATOR}, {METRICS_SQL}")
def validator_metrics(spark, d):
    return validation.metrics(*validator_run(spark, d))


FALLBACKS = {"lookback_s": 300, "most": 0, "nearest": True}


@query(f"with {validator_sql(**FALLBACKS, early=True, unread=True, cache=True)}, {METRICS_SQL}")
def validator_fallbacks(spark, d):
    """With the cache, the nearest past snapshot, snapshots that cannot be read, and no limit of candidates."""
    tables = validator_tables(spark, d, early=True, unread=True)
    return validation.metrics(*validation.run(*tables, validation.Settings(lookback_s=300, most=0, nearest_past=True)))


@query(f"with {validator_sql(prefer_auto=True, unread=True)}, {METRICS_SQL}")
def validator_search_first(spark, d):
    records, cells, snapshots, truth, _, tolerances = validator_tables(spark, d, unread=True)
    return validation.metrics(*validation.run(records, cells, snapshots, truth, None, tolerances, validation.Settings(lookback_s=10_800, most=2, prefer_auto=True)))


@query(f"with {VALIDATOR} select rec, source, hr::varchar snap, round(dt, 6) dt_s from chosen")
def validator_records(spark, d):
    chosen, _ = validator_run(spark, d)
    return chosen.select("rec", "source", "snap", F.round("dt_s", 6).alias("dt_s"))


@query(f"""with {VALIDATOR} select rec, bed, vital, truth, parsed, round(err, 6) abs_error, ok matched, case when parsed is null then case when coalesce("text", '') = '' then 'empty' else 'invalid_numeric:' || "text" end end invalid_reason from item""")
def validator_comparisons(spark, d):
    _, found = validator_run(spark, d)
    return found.select("rec", "bed", "vital", "truth", "parsed", F.round("abs_error", 6).alias("abs_error"), F.col("match").alias("matched"), "invalid_reason")


#: Half hours to ten hours on either side: the snapshots are an hour apart.
LAGS = [x * 1800.0 for x in range(-20, 21)]
LAGS_SQL = "select unnest(range(-20, 21)) * 1800.0::double"
BY_LAG = """a as (select lag_s, count(*) total, count(*) filter (ok) matched, coalesce(round(avg(err), 9), 0.0) mae from item group by lag_s),
  b as (select lag_s, coalesce(total, 0) total, coalesce(matched, 0) matched, coalesce(matched / total, 0.0) rate, coalesce(mae, 0.0) mae from lag left join a using (lag_s))
  select lag_s, total, matched, round(rate, 6) match_rate, round(mae, 6) mean_abs_error, row_number() over (order by rate desc, mae, lag_s) = 1 best from b"""


def _by_lag(df):
    return df.select("lag_s", "total", "matched", F.round("match_rate", 6).alias("match_rate"), F.round("mean_abs_error", 6).alias("mean_abs_error"), "best")


@query(f"with {validator_sql(lags=LAGS_SQL)}, {BY_LAG}")
def auto_lag(spark, d):
    records, cells, snapshots, truth, _, tolerances = validator_tables(spark, d)
    return _by_lag(lags.auto_lag(records, cells, snapshots, truth, None, tolerances, LAGS, validation.Settings(lookback_s=10_800, most=2)))


@query(f"with {validator_sql(**FALLBACKS, early=True, unread=True, cache=True, lags=LAGS_SQL)}, {BY_LAG}")
def auto_lag_fallbacks(spark, d):
    tables = validator_tables(spark, d, early=True, unread=True)
    return _by_lag(lags.auto_lag(*tables, LAGS, validation.Settings(lookback_s=300, most=0, nearest_past=True)))


from . import flows, forms, streams  # noqa: E402, F401  (add their queries)
