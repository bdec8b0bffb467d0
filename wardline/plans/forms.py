"""Queries of single functions over whole tables: names, numbers, times, texts off a screen, and JSON documents to rows.

Texts and documents are built from a row's number, so that every form a function knows comes up, and
the SQL says what must come out of each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import reading_text as R
from ..functions import scalars as S
from ..operators import engines, geometry, latest
from ..sources import records, snapshots
from .registry import query, table


def one_of(number: Column, *options: str | Column | None) -> Column:
    """The option of the number's remainder."""
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


@query("""select event_id, event_id % 8 < 5 truthy, case when event_id % 6 < 2 then 'easy' when event_id % 6 < 4 then 'tess' end engine,
  event_type || '|' || user_id::varchar || '|x' fields from events""")
def name_forms(spark, d):
    i = F.col("event_id")
    fields = F.concat_ws(",", F.concat("event_type", F.lit(" ")), F.concat(F.lit(" "), F.col("user_id").cast("string")), F.lit(""), "event_type", F.lit("x"))
    return table(spark, d, "events").select(
        "event_id", S.truthy(one_of(i, " 1 ", "TRUE", "yes", "Y", "On", "off", "", None)).alias("truthy"),
        S.engine_name(one_of(i, "EasyOCR", " easy", "tess ", "TesseractOCR", "other", None)).alias("engine"), F.array_join(S.csv_set(fields), "|").alias("fields"),
    )


@query(r"select page_id, regexp_replace(url, '[^A-Za-z0-9_.\-]', '_', 'g') as token from pages")
def file_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", S.file_token(F.col("url")).alias("token"))


@query("select event_id, greatest(20.0, least(value, 80.0)) clamped, printf('%.1f', value) one_decimal, value = floor(value) whole from events")
def number_forms(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", S.clamp(v, F.lit(20.0), F.lit(80.0)).alias("clamped"), S.one_decimal(v).alias("one_decimal"), S.is_whole(v).alias("whole"))


@query("""with t as (select event_id, value x, case event_id % 3 when 0 then printf('%.1f', value) when 1 then 'HR' || user_id::varchar else floor(value)::bigint::varchar end a from events),
  s as (select *, round_even(try_cast(a as double), 0)::bigint::varchar b, left(a, 4) c from t)
  select event_id, concat_ws('|', a, case when b is distinct from a then b end, case when c is distinct from a and c is distinct from b then c end) forms,
    case when event_id % 11 = 0 then '....' when event_id % 2 = 0 then printf('%.1f', x) else round_even(x, 0)::bigint::varchar end shown from s""")
def shorter_forms(spark, d):
    i = F.col("event_id")
    v = F.col("value")
    text = one_of(i, S.one_decimal(v), F.concat(F.lit("HR"), F.col("user_id").cast("string")), F.floor(v).cast("bigint").cast("string"))
    shown = S.display_candidates(one_of(i, "TRECT", "HR"), F.when(i % 11 != 0, v))
    return table(spark, d, "events").select("event_id", F.array_join(S.shorter_texts(text), "|").alias("forms"), F.array_join(shown, "|").alias("shown"))


@query("""with p as (select *, case when l_linenumber % 2 = 0 then 'TSKIN' else 'HR' end vital, l_quantity::double a, l_quantity::double + (l_linenumber % 4) * 0.75 b from lineitem),
  t as (select *, case when vital = 'TSKIN' or a <> floor(a) or b <> floor(b) then 0.2 else 1.0 end::double tol from p) select l_orderkey, l_linenumber, tol, abs(a - b) > tol mismatch from t""")
def mismatch_limits(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", n, one_of(n, "TSKIN", "HR").alias("vital"), F.col("l_quantity").cast("double").alias("a"))
    rows = rows.withColumn("b", F.col("a") + (n % 4) * F.lit(0.75))
    rows = rows.withColumn("tol", S.mismatch_tolerance(F.col("vital"), F.col("a"), F.col("b")).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", "tol", (F.abs(F.col("a") - F.col("b")) > F.col("tol")).alias("mismatch"))


@query("""with o as (select o_orderkey, o_orderdate::date::timestamp d, o_orderkey % 6 k from orders),
  t as (select *, case k when 0 then 37230 when 1 then 4830 when 2 then 30030 when 3 then -32400 end::bigint s from o)
  select o_orderkey, epoch(d)::bigint + s as seconds, strftime(d + to_seconds(s + 32400), '%Y-%m-%dT%H:%M:%S+09:00') tokyo from t""")
def iso_times(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    with_end = lambda end: F.concat(day, F.lit(end))
    text = one_of(F.col("o_orderkey"), with_end("T10:20:30Z"), with_end(" 10:20:30"), with_end("T10:20:30+02:00"), day, "2026", "no time")
    rows = table(spark, d, "orders").select("o_orderkey", S.iso_time(text).alias("t"))
    return rows.select("o_orderkey", F.unix_seconds("t").alias("seconds"), S.tokyo_iso(F.col("t")).alias("tokyo"))


@query("""with e as (select event_id, event_id % 6 k, coalesce(floor(value), 0)::bigint n from events)
  select event_id, case k when 0 then '00' when 1 then (30 + n % 10)::varchar when 2 then '-0.' || (1 + n % 9)::varchar when 3 then '0.' || (n % 10)::varchar when 4 then n::varchar || '1' else n::varchar end digits,
    case k when 3 then false when 4 then length(n::varchar) < 3 else true end formed, case k when 1 then (30 + n % 10)::double when 5 then case when n <= 2000 then n::double end end parsed,
    case when k in (1, 3) then '0123456789.' when k = 2 then '0123456789.-' else '0123456789' end allowed from e""")
def screen_texts(spark, d):
    i = F.col("event_id")
    n = F.coalesce(F.floor("value"), F.lit(0)).cast("bigint")
    s = lambda c: c.cast("string")
    text = one_of(i, "OO", F.concat(s(30 + n % 10), F.lit(".")), F.concat(F.lit("-."), s(1 + n % 9)), F.concat(F.lit("."), s(n % 10)), F.concat(s(n), F.lit("/1")), s(n))
    rows = table(spark, d, "events").select("event_id", one_of(i, "HR", "TSKIN", "CVP_M", "TRECT", "HR", "VTi").alias("vital"), text.alias("text"))
    rows = rows.withColumn("digits", R.digits_like(F.col("vital"), F.col("text")))
    return rows.select("event_id", "digits", R.well_formed(F.col("vital"), F.col("digits")).alias("formed"), R.parsed_reading(F.col("vital"), F.col("text")).alias("parsed"), R.allowlist(F.col("vital")).alias("allowed"))


@query("""with e as (select *, event_id % 4 <> 0 and event_id % 2 = 0 and event_id % 3 = 0 all_empty from events) select event_id, all_empty,
  case when event_id % 13 = 0 or event_id % 7 = 0 then 'empty' when event_id % 5 = 0 then 'no_match' when event_id % 5 = 1 then 'fallback_tesseract'
    when event_id % 10 < 4 then 'low_conf' when event_id % 17 = 0 then 'exception' when all_empty then 'parse_fail' end reason from e""")
def failed_reasons(spark, d):
    i = F.col("event_id")
    passes = F.when(i % 4 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).otherwise(F.create_map(F.lit("a"), F.array_repeat(F.lit("x"), (i % 2).cast("int")), F.lit("b"), F.array_repeat(F.lit("x"), (i % 3).cast("int"))))
    text, value = F.when(i % 13 == 0, "").otherwise("7"), F.when(i % 7 != 0, F.lit(7.0))
    rows = table(spark, d, "events").select("event_id", R.all_passes_empty(passes).alias("all_empty"))
    reason = R.failed_reading(text, value, one_of(i, "no_match", "fallback_tesseract", "own", "own", "own"), (i % 10) / 10, 0.4, i % 17 == 0, F.col("all_empty"))
    return rows.select("event_id", "all_empty", reason.alias("reason"))


@query("""select l_orderkey, l_linenumber, l_returnflag from lineitem
  qualify row_number() over (partition by l_orderkey order by (l_returnflag = 'R') desc, l_linenumber, l_returnflag) = 1""")
def primary_or_first(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return latest.flagged_or_first(lines, ["l_orderkey"], F.col("l_returnflag") == "R", ["l_linenumber", "l_returnflag"])


@query("""with p as (select p_partkey, p_size::double a, p_size + 10.0 b, p_partkey % 5 + 1 n from part), x as (select *, unnest(range(n)) i from p)
  select p_partkey, i::int place, round(case when n = 1 then a else a + (b - a) * i / (n - 1) end, 6)::double x from x""")
def even_places(spark, d):
    a = F.col("p_size").cast("double")
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(geometry.evenly(a, a + 10.0, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("place", "x"))
    return rows.select("p_partkey", "place", F.round("x", 6).alias("x"))


@query("""with t as (select l_orderkey, l_linenumber, l_quantity::double * 2 - 10 conf from lineitem)
  select l_orderkey, round(avg(conf) filter (conf >= 0) / 100, 6) confidence, string_agg(l_linenumber::varchar, '' order by l_linenumber) as text from t group by l_orderkey""")
def token_confidence(spark, d):
    tokens = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("token"), (F.col("l_quantity").cast("double") * 2 - 10).alias("conf"))
    joined = engines.joined_tokens(tokens, ["l_orderkey"], "l_linenumber", "token", "conf")
    return joined.select("l_orderkey", F.round("confidence", 6).alias("confidence"), "text")


def documents_of(spark, d, text: Column):
    """A snapshot for each event, its number as the path; the text is read as JSON."""
    i = F.col("event_id")
    return table(spark, d, "events").select(i.cast("string").alias("path"), F.col("ts").alias("snapshot_ts"), F.try_parse_json(text).alias("doc"))


@query("""select event_id::varchar path, bed, vital, x truth from (
  select event_id, 'BED01' bed, 'HR' vital, (event_id % 90)::double x from events union all select event_id, 'BED01', 'RR', (event_id % 7)::double from events
  union all select event_id, 'BED01', 'SpO2', (event_id % 50)::double from events union all select event_id, 'BED02', null, null from events)""")
def truth_flatten(spark, d):
    i = F.col("event_id")
    n = lambda k: (i % k).cast("string")
    doc = F.concat(F.lit('{"beds": {"BED01": {"vitals": {"HR": {"value": '), n(90), F.lit('}, "RR": '), n(7), F.lit('}, "HR": {"value": -1}, "SpO2": {"value": "'), n(50), F.lit('"}, "values": {"value": 1}}, "BED02": {"name": "x"}}}'))
    return snapshots.truth(documents_of(spark, d, doc)).select("path", "bed", "vital", "truth")


@query("""select event_id::varchar path, case event_id % 4 when 0 then epoch(timestamp '2024-01-02 03:04:05')::bigint when 1 then epoch(timestamp '2024-03-01 00:00:00')::bigint - 32400
  when 2 then epoch(timestamp '2024-05-06 07:08:09')::bigint end as seconds from events""")
def snapshot_times(spark, d):
    i = F.col("event_id")
    doc = one_of(
        i, '{"updated_at": "2024-01-02T03:04:05Z", "timestamp": "2020-01-01"}', '{"captured_at": "soon", "meta": {"message_datetime": "2024-03-01"}}',
        '{"beds": {"B2": {"message_datetime": "2024-07-01"}, "B1": {"message_datetime": "2024-05-06T07:08:09+00:00"}}}', '{"beds": {"B1": {}}}',
    )
    return snapshots.event_time(documents_of(spark, d, doc)).select("path", F.unix_seconds("event_ts").alias("seconds"))


@query("""select event_id, case event_id % 3 when 0 then 'capture_timestamp' when 1 then 'timestamp' end reference_key,
  case event_id % 3 when 0 then epoch(timestamp '2024-01-02 03:04:05')::bigint when 1 then epoch(timestamp '2024-02-01 00:00:00')::bigint - 32400 end as seconds from events""")
def record_times(spark, d):
    i = F.col("event_id")
    doc = one_of(i, '{"capture_timestamp": "2024-01-02 03:04:05+00:00", "timestamp": "2020-01-01"}', '{"capture_timestamp": "2024", "ocr_timestamp": null, "timestamp": "2024-02-01"}', '{"timestamp": 5}')
    rows = records.times(table(spark, d, "events").select("event_id", F.try_parse_json(doc).alias("doc")))
    return rows.select("event_id", "reference_key", F.unix_seconds("reference_ts").alias("seconds"))


@query("""with e as (select event_id, event_id % 4 k, (event_id % 50)::double n from events)
  select event_id, case k when 0 then n when 1 then n + 1 when 3 then n + 0.5 end easy_value, case when k = 2 then 'missing' else 'valid' end easy_status, case k when 0 then 0.5 when 1 then 0.9 end::double easy_confidence,
    case k when 0 then 7.0 when 2 then n end::double tess_value, case k when 0 then 'valid' when 1 then 'invalid' when 2 then 'valid' else 'missing' end tess_status from e""")
def candidate_forms(spark, d):
    i = F.col("event_id")
    n = (i % 50).cast("string")
    leaf = one_of(
        i, F.concat(F.lit('{"easy": {"text": "'), n, F.lit(' bpm", "confidence": 0.5}, "tess": 7}')),
        F.concat(F.lit('{"candidates": [{"engine": "easyocr", "text": "-5", "conf": 0.2}, {"engine": "EasyOCR", "text": "'), (i % 50 + 1).cast("string"), F.lit('", "conf": 0.9}, {"name": "tess", "text": "x"}]}')),
        F.concat(F.lit('{"text": "'), n, F.lit('", "confidence": 0.3, "selected_engine": "tesseract"}')), F.concat(F.lit('{"candidates": {"easy": {"value": '), n, F.lit(".5}}}")),
    )
    found = records.engine_candidates(table(spark, d, "events").select("event_id", F.try_parse_json(leaf).alias("leaf")))
    return found.select("event_id", F.col("easy.value").alias("easy_value"), F.col("easy.status").alias("easy_status"), F.col("easy.confidence").alias("easy_confidence"), F.col("tess.value").alias("tess_value"), F.col("tess.status").alias("tess_status"))


@query("""with e as (select event_id, event_id % 5 k, event_id % 20 + 1 n, event_id % 10 d, event_id % 9 + 1 h from events)
  select event_id, case k when 0 then n::varchar when 1 then d::varchar || d::varchar when 2 then d || '.' || h when 3 then '1' || d || '.' when 4 then h || '10' end plain from e""")
def compatibility_forms(spark, d):
    """Circled, bold, full-width, fraction and month characters, as numbers of a field with a point."""
    i = F.col("event_id")
    at = lambda n, low, k: F.element_at(F.array(*[F.lit(chr(low + x)) for x in range(k)]), (n + 1).cast("int"))
    circled, bold, wide, month = (lambda n: at(n, 0x2460, 20)), (lambda n: at(n, 0x1D7CE, 10)), (lambda n: at(n, 0xFF10, 10)), (lambda n: at(n, 0x32C0, 9))
    text = one_of(i, circled(i % 20), F.concat(bold(i % 10), F.lit(" "), wide(i % 10)), F.concat(wide(i % 10), F.lit("\uff0e"), at(i % 9, 0x2488, 9)), F.concat(F.lit("\u00b9"), wide(i % 10), F.lit("\u2025")), F.concat(month(i % 9), F.lit("\u2169\u2469")))
    return table(spark, d, "events").select("event_id", R.normalized(F.lit("TSKIN"), text).alias("plain"))


@query("""select event_id, case event_id % 5 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('day', ts) + interval '3 hours 4 minutes 5 seconds' end shown from events""")
def shown_times(spark, d):
    """Times as a monitor writes them, packed, without leading zeros, of a day that is none, and with a zone."""
    t = lambda f: F.date_format("ts", f)
    text = one_of(F.col("event_id"), t("yyyy-MM-dd HH:mm:ss"), t("yyyyMMddHHmmss"), F.concat(t("yyyy-M-d"), F.lit(" 3:4:5")), F.lit("2024-02-30 00:00:00"), F.concat(t("yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
    return table(spark, d, "events").select("event_id", S.shown_time(text).alias("shown"))


@query("""with e as (select event_id, event_id % 3 m, event_id % 17 = 0 compare, event_id % 2 = 0 fallback, event_id % 5 < 3 wanted, case when event_id % 7 <> 0 then value end ev, (event_id * 13 % 100) / 100.0::double ec, event_id % 19 = 0 failed, event_id % 23 = 0 no_easy, event_id % 4 <> 0 has_tess, value + 1 tv from events),
  u as (select *, no_easy or ev is null or failed or ec < 0.4 useless from e), r as (select *, compare or m = 1 or (m = 2 and wanted) or (m = 0 and fallback and useless) ran from u), s as (select *, ran and has_tess both_there from r),
  t as (select *, case when m = 1 then true when m = 2 then useless and both_there else both_there end takes from s)
  select event_id, case when takes then 'tesseract' else 'easyocr' end selected, ran tess_ran, case when takes then case when both_there then tv end when no_easy then null else ev end "value" from t""")
def engine_routing(spark, d):
    """Which engine's reading counts, by mode, and whether the second runs."""
    i = F.col("event_id")
    easy = F.when(i % 23 != 0, F.struct(F.lit("x").alias("text"), F.when(i % 7 != 0, F.col("value")).alias("value"), ((i * 13 % 100) / 100).alias("conf"), (i % 19 == 0).alias("failed")))
    tess = F.when(i % 4 != 0, F.struct(F.lit("x").alias("text"), (F.col("value") + 1).alias("value")))
    route = engines.routed(easy, tess, one_of(i, "easyocr", "tesseract", "both"), 0.4, i % 2 == 0, i % 5 < 3, i % 17 == 0)
    return table(spark, d, "events").select("event_id", route.alias("r")).select("event_id", "r.*")


@query("""with v as (select l_orderkey k, l_linenumber n, case when l_linenumber % 3 <> 0 then l_quantity::double end x, case when l_linenumber = 5 then -1.0 else l_discount::double end c, 'v' || l_linenumber variant from lineitem),
  b as (select *, row_number() over (partition by k order by x is null, c desc, n, x) r from v where c >= 0), a as (select k, n, variant, x, c from b where r = 1)
  select keys.k, coalesce(variant, 'normal') variant, coalesce(c, 0.0) confidence, x is not null valid from (select distinct k from v) keys left join a using (k)""")
def best_variants(spark, d):
    """Of each order's lines, as variants of one reading, the most confident with a value, else the most confident."""
    n = F.col("l_linenumber")
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n, F.when(n % 3 != 0, F.col("l_quantity").cast("double")).alias("value"), F.when(n == 5, -1.0).otherwise(F.col("l_discount").cast("double")).alias("confidence"), F.concat(F.lit("v"), n.cast("string")).alias("variant"), F.lit("x").alias("text"))
    best = engines.best_variant(v, ["k"], "l_linenumber")
    return best.select("k", "variant", "confidence", F.col("value").isNotNull().alias("valid"))
