"""Queries of whole flows: framed feeds, versions of snapshots, paths, the comparer of engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, comparer, messages, screens, versions
from ..sources import feeds, paths, sinks
from ..streaming import state
from .registry import GRID_SQL, query, table


def _hour():
    return F.floor(asof.micros("ts") / 3_600_000_000).cast("long")


@query("""with m as (select user_id, ts::date as dd, event_type, arg_max(value, event_id) v from events group by all), n as (select user_id, dd, count(*) vitals from m group by all)
  select user_id::varchar bed_id, strftime(dd, '%Y%m%d') as "day", event_type vital, v "value", vitals::bigint vitals from m join n using (user_id, dd)""")
def framed_feed(spark, d):
    """Messages landed as framed bytes, read back in splits and parsed: one for each user and day."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    built = messages.build(e, ["user_id", "day"], "user_id", "user_id", "ts", "event_type", "value", "event_id")
    folder = f"{state.shared_folder(spark)}/feed"
    sinks.framed(built, "message", folder)
    found = messages.observations(messages.parse(feeds.framed_files(spark, folder).select("message"), "message"))
    day = F.element_at(F.split("control_id", "-"), -1)
    n = F.count("*").over(Window.partitionBy("control_id"))  # of one message
    return found.select("bed_id", day.alias("day"), "vital", "value", n.alias("vitals"))


LEVELS = "lv as (select (epoch_us(ts) // 3600000000)::bigint h, user_id % 40 bed, event_type vital, floor(arg_max(value, event_id) / 40)::bigint as level from events group by all)"


def levels(spark, d):
    """What hourly snapshots hold: of a bed and vital heard of in the hour, the last value in steps of forty."""
    e = table(spark, d, "events").select(_hour().alias("h"), (F.col("user_id") % 40).alias("bed"), F.col("event_type").alias("vital"), "event_id", "value")
    return e.groupBy("h", "bed", "vital").agg(F.floor(F.max_by("value", "event_id") / 40).cast("long").alias("level"))


@query(f"""with {LEVELS}, n as (select h, row_number() over (order by h) n from (select distinct h from lv)), s as (select lv.*, n, case when lag(n) over w = n - 1 and lag(level) over w = level then 0 else 1 end new from lv join n using (h) window w as (partition by bed, vital order by n)),
  r as (select *, sum(new) over (partition by bed, vital order by n) run from s), i as (select bed, vital, level, min(h) f, max(n) + 1 e from r group by bed, vital, level, run)
  select bed, vital, level, make_timestamp(f * 3600000000) valid_from, make_timestamp(n.h * 3600000000) valid_to from i left join n on n.n = i.e""")
def snapshot_versions(spark, d):
    at = F.timestamp_add("HOUR", F.col("h").cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return versions.intervals(levels(spark, d).withColumn("at", at).drop("h"), ["bed", "vital"], "at", ["level"])


@query(f"""with {LEVELS}, h as (select distinct h from lv), a as (select event_id, user_id % 40 bed, event_type vital, h.h from events asof left join h on events.ts >= make_timestamp(h.h * 3600000000) + interval 30 minute)
  select event_id, level from a left join lv using (h, bed, vital)""")
def versions_as_of(spark, d):
    """What the snapshot half an hour old or older said of each event's bed and vital, read from the intervals."""
    at = F.timestamp_add("MINUTE", (F.col("h") * 60 + 30).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    kept = versions.intervals(levels(spark, d).withColumn("at", at).drop("h"), ["bed", "vital"], "at", ["level"])
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("bed"), F.col("event_type").alias("vital"))
    return versions.as_of(e, kept, ["bed", "vital"], "ts").select("event_id", "level")


@query("""with f as (select distinct (epoch_us(ts) // 3600000000)::bigint h from events),
  n as (select event_id, (epoch_us(ts) // 3600000000)::bigint h, event_id % 6 k from events)
  select event_id, case when k = 0 then '/data/a/h' || h || '.json' when k = 1 and h % 3 = 0 then '/data/b/h' || h || '.json' when k = 1 then '/data/a/h' || h || '.json' when k = 2 then '/data/a/h' || h || '.json' when k = 4 then '/runs/' || h % 5 || '/x.json' end file from n""")
def path_resolution(spark, d):
    """Absolute paths, paths below two roots that both may have the file, paths up and down, missing ones, and ones beside the record."""
    e = table(spark, d, "events").select("event_id", _hour().alias("h"), (F.col("event_id") % 6).alias("k"))
    h = F.col("h").cast("string")
    file = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    hours = e.select("h").distinct()
    files = hours.select(file("/data/a/h", h, ".json").alias("file")).union(hours.where("h % 3 = 0").select(file("/data/b/h", h, ".json"))).union(hours.select(file("/runs/", (F.col("h") % 5).cast("string"), "/x.json")))
    k = F.col("k")
    named = F.when(k == 0, file("/data//a/./h", h, ".json")).when(k == 1, file("h", h, ".json")).when(k == 2, file("..\\a\\c\\..\\h", h, ".json")).when(k == 3, file("gone/h", h, ".json")).when(k == 4, F.lit("x.json")).otherwise(F.lit(""))
    rows = e.select("event_id", named.alias("named"), file("/runs/", (F.col("h") % 5).cast("string")).alias("beside"))
    return paths.resolve(rows, files.dropDuplicates(["file"]), "named", ["/data/b", "/data/a"], ["beside"]).select("event_id", "file")


COMPARER = """h as (select *, (epoch_us(ts) // 3600000000)::bigint hr, 'BED0' || (user_id % 6 + 1) bed, event_type field from events),
  tr as (select hr, bed, field, arg_max(value, event_id) v, max(event_id) i from h group by all),
  used as (select hr, hr % 3 = 0 and hr % 4 <> 2 b from (select distinct hr from h) where hr % 7 <> 0 and (hr % 3 = 0 and hr % 4 <> 2 or hr % 11 <> 0)),
  c as (select hr line, bed, field, v + case when b then 1 else 0 end truth, case when i % 5 = 0 then null when i % 9 = 0 then '--' else v::decimal(18,2)::varchar || ' u' end et, case when i % 7 <> 0 then (v::decimal(18,2) + 1)::varchar end tt from tr join used using (hr)),
  x as (select *, try_cast(replace(et, ' u', '') as double) easy_value, try_cast(tt as double) tess_value, case field when 'click' then 0.3 when 'view' then 0.5 else 0.0 end tol from c),
  cmp as (select *, abs(easy_value - truth) ee, abs(tess_value - truth) te, coalesce(abs(easy_value - truth) <= tol, false) em, coalesce(abs(tess_value - truth) <= tol, false) tm,
    case when easy_value is null and tess_value is null then 'none' when tess_value is null or abs(easy_value - truth) < abs(tess_value - truth) then 'easy' when easy_value is null or abs(tess_value - truth) < abs(easy_value - truth) then 'tess' else 'tie' end winner from x)"""


def comparer_rows(spark, d):
    """Records of hours, as JSON, each naming its hour's snapshot under one of two roots; some name none that is there, some a broken one."""
    e = table(spark, d, "events").select("event_id", "value", _hour().alias("hr"), F.concat(F.lit("BED0"), (F.col("user_id") % 6 + 1).cast("string")).alias("bed"), F.col("event_type").alias("field"))
    last = e.groupBy("hr", "bed", "field").agg(F.max_by("value", "event_id").alias("v"), F.max("event_id").alias("i"))
    one = F.col("v").cast("decimal(18,2)")
    easy = F.when(F.col("i") % 5 == 0, F.lit(None).cast("string")).when(F.col("i") % 9 == 0, "--").otherwise(F.concat(one.cast("string"), F.lit(" u")))
    tess = F.when(F.col("i") % 7 != 0, (one + 1).cast("decimal(18,2)").cast("string"))
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    beds = last.groupBy("hr", "bed").agg(entries("field", F.struct(F.struct(easy.alias("text")).alias("easy"), F.struct(tess.alias("text")).alias("tess"))).alias("fields")).groupBy("hr").agg(entries("bed", F.col("fields")).alias("beds"))
    r = F.col("hr")
    name = F.concat(F.lit("h"), r.cast("string"), F.lit(".json"))
    path = F.when(r % 7 == 0, F.concat(F.lit("gone/"), name)).when(r % 4 == 2, F.concat(F.lit("/data/a/"), name)).when(r % 4 == 1, F.concat(F.lit(".\\"), name)).otherwise(name)
    lines = beds.select(r.alias("line"), F.try_parse_json(F.to_json(F.struct(path.alias("cache_snapshot_path_before"), "beds"))).alias("doc"))

    def snapshots(folder: str, more: int):
        vitals = last.groupBy("hr", "bed").agg(entries("field", F.struct((F.col("v") + more).alias("value"))).alias("vitals")).groupBy("hr").agg(entries("bed", F.struct("vitals")).alias("beds"))
        return vitals.select("hr", F.concat(F.lit(folder), name).alias("path"), F.to_json(F.struct("beds")).alias("text"))

    text = F.when((r % 11 == 0) & F.col("path").startswith("/data/a"), F.lit("{broken")).otherwise(F.col("text"))
    documents = snapshots("/data/a/", 0).union(snapshots("/data/b/", 1).where("hr % 3 = 0")).select("path", F.try_parse_json(text).alias("doc"))
    tolerances = spark.createDataFrame([("click", 0.3), ("view", 0.5)], "vital string, tol double")
    rows = comparer.compared(lines, documents, tolerances, ["/data/b", "/data/a"])
    # Statistics, medians and digits each read the rows: documents are parsed once.
    folder = f"{state.shared_folder(spark)}/compared"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


@query(f"with {COMPARER} select line, bed, field, truth, easy_value, tess_value, round(ee, 6) easy_abs_err, round(te, 6) tess_abs_err, winner from cmp")
def comparer_winloss(spark, d):
    return comparer_rows(spark, d).select("line", "bed", "field", "truth", "easy_value", "tess_value", F.round("easy_abs_err", 6).alias("easy_abs_err"), F.round("tess_abs_err", 6).alias("tess_abs_err"), "winner")


@query(f"""with {COMPARER} select field, count(*) n, count(*) filter (winner = 'easy') easy_win, count(*) filter (winner = 'tess') tess_win, count(*) filter (winner = 'tie') tie, count(*) filter (winner = 'none') both_bad,
  round((count(*) filter (em) + count(*) filter (tm)) / (2 * count(*)), 4) match_rate, round(avg(ee), 4) easy_mae, round(count(*) filter (em) / count(*), 4) easy_match_rate,
  round(count(*) filter (et is null) / count(*), 4) easy_missing_rate, round(count(*) filter (easy_value is null and et is not null) / count(*), 4) easy_invalid_rate,
  round(avg(te), 4) tess_mae, round(count(*) filter (tm) / count(*), 4) tess_match_rate, round(count(*) filter (tt is null) / count(*), 4) tess_missing_rate, round(count(*) filter (tess_value is null and tt is not null) / count(*), 4) tess_invalid_rate,
  round(avg(case when winner = 'tess' then te else ee end), 4) winner_mae, round(median(case when winner = 'tess' then te else ee end), 4) winner_median from cmp group by grouping sets ((field), ())""")
def comparer_statistics(spark, d):
    return comparer.statistics(comparer_rows(spark, d), digits=4)


@query(f"""with {COMPARER}, e as (select 'easy' engine, truth, et as text from cmp where easy_value is not null union all select 'tess', truth, tt from cmp where tess_value is not null),
  g as (select engine, regexp_replace(regexp_replace(truth::decimal(38,10)::varchar, '\\.?0+$', ''), '[^0-9]', '', 'g') a, regexp_replace(text, '[^0-9]', '', 'g') b from e), p as (select *, unnest(range(1, greatest(length(a), length(b)) + 1)) i from g)
  select engine, coalesce(nullif(substring(a, i, 1), ''), '_') truth_digit, coalesce(nullif(substring(b, i, 1), ''), '_') pred_digit, count(*) "count" from p group by all""")
def comparer_digits(spark, d):
    return comparer.confusion(comparer_rows(spark, d))


#: Maps of three screens, a document an hour; some are broken, some lack items.
MAPS = """m as (select (epoch_us(ts) // 3600000000)::bigint h, user_id % 3 screen, 'BED0' || (user_id % 6 + 1) bed, case event_type when 'view' then 'VTe' when 'click' then 'HR' when 'purchase' then 'NOTE' else 'SpO2' end vital,
    max(struct_pack(k := case when event_id % 17 = 0 then 0 else 1 end, x := (floor(value)::bigint // 40) * 60 - 40, y := (user_id % 11) * 50, w := 20 + 37 * (event_id % 5), h := 25 + 10 * (event_id % 3))) b from events group by all),
  t as (select distinct h, screen from m where h % 7 <> 0 and h % 11 <> 0), placed as (select h, screen, bed, vital, h % 2 = 0 own, b.x - case when screen = 0 then 50 else 0 end x, b.y - case when screen = 0 then 20 else 0 end y, b.w w, b.h hh from m join t using (h, screen) where b.k = 1 and vital <> 'NOTE'),
  f as (select *, greatest(x, 0) x1, greatest(y, 0) y1, least(x + w, 640) x2, least(y + hh, 480) y2 from placed where x + w > 0 and y + hh > 0 and x < 640 and y < 480),
  g as (select *, case when own then x1 else x1 + floor((x2 - x1) * 0.6::double)::bigint end rx1, case when own then y1 else y1 + floor((y2 - y1) * 0.1::double)::bigint end ry1, case when own then x2 else x1 + floor((x2 - x1) * 0.98::double)::bigint end rx2_, case when own then y2 else y1 + floor((y2 - y1) * 0.92::double)::bigint end ry2_ from f),
  i as (select *, greatest(rx2_, rx1 + 1) rx2__, greatest(ry2_, ry1 + 1) ry2 from g), laid as (select *, case when vital = 'VTe' then least(rx2__ + greatest(1, round_even((rx2__ - rx1) * 0.3::double, 0)::bigint), 640) else rx2__ end rx2 from i),
  fr as (select event_id, user_id % 3 screen, t.h from events e asof left join t on e.user_id % 3 = t.screen and e.ts >= make_timestamp((t.h + 1) * 3600000000)),
  c as (select event_id, 'exported' source, bed, vital, x1, y1, x2, y2, rx1, ry1, rx2, ry2 from fr join laid using (h, screen)
    union all select event_id, 'split', bed, vital, x1, y1, x2, y2, x1, y1, x2, y2 from fr, sp where h is null)"""
SPLIT = f"""v(vital, vi) as (values {GRID_SQL}), sp as (select 'BED0' || (bi + 1)::varchar bed, vital, (bi % 2) * 320 + (vi % 4) * 80 x1, (bi // 2) * 160 + (vi // 4) * 32 y1, x1 + 80 x2, y1 + 32 y2 from range(6) b(bi), v)"""


def frame_cells(spark, d):
    """Every event is a frame of one of three screens, captured in its own rectangle or the common one; the last map of its screen is laid on it."""
    e = table(spark, d, "events").withColumn("screen", F.col("user_id") % 3)
    vital = F.when(F.col("event_type") == "view", "VTe").when(F.col("event_type") == "click", "HR").when(F.col("event_type") == "purchase", "NOTE").otherwise("SpO2")
    i, u = F.col("event_id"), F.col("user_id")
    box = F.struct(F.when(i % 17 == 0, 0).otherwise(1).alias("k"), (F.floor(F.floor("value").cast("long") / 40) * 60 - 40).alias("x"), ((u % 11) * 50).alias("y"), (37 * (i % 5) + 20).alias("w"), (10 * (i % 3) + 25).alias("h"))
    last = e.select(_hour().alias("hr"), "screen", F.concat(F.lit("BED0"), (u % 6 + 1).cast("string")).alias("bed"), vital.alias("vital"), box.alias("b")).groupBy("hr", "screen", "bed", "vital").agg(F.max("b").alias("b"))
    end = F.timestamp_seconds((F.col("hr") + 1) * 3600)
    widgets = last.select("hr", "screen", "bed", "vital", "b.x", "b.y", (F.col("b.w") * F.col("b.k")).alias("w"), "b.h", end.alias("at"))
    kinds = [screens.export(widgets.where(F.col("hr") % 2 == r), ["hr", "screen"], "at", kind) for r, kind in ((0, screens.VALUE_BOXES), (1, "cells"))]
    text = F.when(F.col("hr") % 7 == 0, F.substring("document", 1, 60)).when(F.col("hr") % 11 == 0, F.replace("document", F.lit('"items"'), F.lit('"item"'))).otherwise(F.col("document"))
    folder = f"{state.shared_folder(spark)}/maps"
    kinds[0].unionByName(kinds[1]).select("screen", text.alias("document")).write.parquet(folder)
    documents = spark.read.parquet(folder)
    us = F.unix_micros("generated_at")
    maps = screens.load(documents, ["screen"]).withColumn("generated_at", F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    stood = screens.validity(maps, ["screen"])
    rectangle = lambda *sides: F.struct(*[x.cast("int").alias(n) for n, x in zip(("left", "top", "width", "height"), sides, strict=True)])
    s = F.col("screen")
    rect = screens.capture(F.when(s < 2, rectangle(F.lit(50), F.lit(20), F.when(s == 0, 640).otherwise(0), F.lit(480))), rectangle(F.lit(0), F.lit(0), F.lit(640), F.lit(480)))
    frames = e.select("event_id", "screen", F.col("ts").cast("timestamp_ntz").alias("ts"), rect.alias("r")).select("event_id", "screen", "ts", "r.*")
    return screens.cells(frames, stood, ["screen"], "ts")


@query(f"with {SPLIT}, {MAPS} select event_id, source, bed, vital, x1::bigint x1, y1::bigint y1, x2::bigint x2, y2::bigint y2, rx1::bigint rx1, ry1::bigint ry1, rx2::bigint rx2, ry2::bigint ry2 from c")
def screen_maps(spark, d):
    return frame_cells(spark, d).drop("screen", "ts", "left", "top", "width", "height")


@query(f"""with {SPLIT}, {MAPS}, bx as (select event_id, (floor(value)::bigint * 7) % 600 u1, (event_id * 13) % 440 v1, u1 + 40 + event_id % 90 u2, v1 + 30 + event_id % 50 v2 from events),
  o as (select event_id, source, bed, vital, (least(rx2, u2) - greatest(rx1, u1)) * (least(ry2, v2) - greatest(ry1, v1)) area from c join bx using (event_id) where least(rx2, u2) > greatest(rx1, u1) and least(ry2, v2) > greatest(ry1, v1))
  select event_id, source, bed, vital, area::bigint area from o qualify row_number() over (partition by event_id order by area desc, bed, vital) = 1""")
def named_boxes(spark, d):
    """A box found on each frame takes the name of the value it shares most area with."""
    i, value = F.col("event_id"), F.floor("value").cast("long")
    found = table(spark, d, "events").select("event_id", (value * 7 % 600).alias("u1"), (i * 13 % 440).alias("v1")).withColumns({"u2": F.col("u1") + 40 + i % 90, "v2": F.col("v1") + 30 + i % 50})
    read = frame_cells(spark, d).select("event_id", "source", "bed", "vital", *[F.col(f"r{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    pairs = screens.overlaps(read, found, ["event_id"])
    best = F.min_by(F.struct("source", "bed", "vital", "area"), F.struct(-F.col("area"), F.col("bed"), F.col("vital")))
    return pairs.groupBy("event_id").agg(best.alias("_b")).select("event_id", "_b.*")
