"""Delimited clinical observation messages: building and parsing with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.reading_text import let
from ..functions.scalars import clean_number, message_time

LINE_BREAKS = r"[\r\n\x0b\x0c\x1c-\x1e\x85  ]+"
START, END = "\x0b", "\x1c"


def frames(payload: Column) -> Column:
    """All messages of a byte stream between start and end blocks (each, not only the first)."""
    return F.regexp_extract_all(payload, F.lit(f"{START}([^{END}]*){END}"), F.lit(1))


def framed(message: Column) -> Column:
    return F.concat(F.lit(START), message, F.lit(END + "\r"))


def acknowledgement(message_type: Column, accepted: Column, sent: Column) -> Column:
    """The reply to a message, which names its type; ``sent`` is the reply's time as yyyyMMddHHmmss."""
    # Fixed: the wire text of replies.
    head = F.concat(F.lit("MSH|^~\\&|RECEIVER|ICU|SENDER|ICU|"), sent)
    yes = F.concat(head, F.lit("||ACK^R01|ACK"), sent, F.lit("|P|2.5\nMSA|AA|"), message_type, F.lit("|OK|Message accepted"))
    no = F.concat(head, F.lit("||ACK|NACK"), sent, F.lit("|P|2.5\nMSA|AE|UNKNOWN||Message rejected"))
    return F.when(accepted, yes).otherwise(no)


def is_acknowledged(reply: Column) -> Column:
    return F.coalesce(F.contains(reply, F.lit("MSA|AA")), F.lit(False))


def segments(message: Column) -> Column:
    """Trimmed segments that are not empty; none where the first is not MSH."""
    found = F.filter(F.transform(F.split(message, LINE_BREAKS, -1), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.get(found, F.lit(0)).startswith("MSH"), found)


def _parts(text: Column, separator: Column) -> Column:
    """Split at a separator that is a column: it is quoted, so that no character of it is a pattern."""
    return F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)


def parse(df: DataFrame, message_col: str = "message", received_col: str | None = None) -> DataFrame:
    """One row per message that starts with MSH, all other columns kept, with ``message_type``, ``message_time``, ``control_id``,
    ``patient_id``, ``patient_name``, ``bed_id`` and ``observations`` (last of each name, in order of their last places).

    Separators are those the message declares. The last MSH, PID and PV1 count. Where the message has no time,
    ``received_col`` (if given) stands in.
    """
    first = F.get(F.col("_segments"), F.lit(0))
    df = df.withColumn("_segments", segments(F.col(message_col))).where(F.col("_segments").isNotNull())
    df = df.withColumn("_field", F.when(F.length(first) > 3, F.substring(first, 4, 1)).otherwise("|"))
    declared = F.get(_parts(first, F.col("_field")), F.lit(1))
    df = df.withColumn("_component", F.when(F.length(declared) >= 4, F.substring(declared, 1, 1)).otherwise("^"))
    df = df.withColumn("_fields", F.transform("_segments", lambda s: _parts(s, F.col("_field"))))
    kind = lambda f: F.get(f, F.lit(0))
    last = lambda k: F.element_at(F.filter("_fields", lambda f: kind(f) == k), -1)
    has = lambda k: F.exists("_fields", lambda f: kind(f) == k)
    for k in ("PID", "PV1"):
        df = df.withColumn(f"_{k}", F.when(has(k), last(k)))
    df = df.withColumn("_MSH", last("MSH"))
    field = lambda segment, i: F.coalesce(F.get(F.col(segment), F.lit(i)), F.lit(""))
    comp = lambda text: _parts(text, F.col("_component"))
    df = df.withColumns({"_name": comp(field("_PID", 5)), "_place": comp(field("_PV1", 3)), "_time": field("_MSH", 6)})
    name, place = F.col("_name"), F.col("_place")
    df = df.withColumns({
        "message_type": field("_MSH", 8),
        "message_time": F.coalesce(message_time(F.col("_time")), F.col(received_col) if received_col else F.lit(None).cast("timestamp_ntz")),
        "control_id": field("_MSH", 9),
        "patient_id": F.get(comp(field("_PID", 3)), F.lit(0)),
        "patient_name": F.when(F.size(name) >= 2, F.concat_ws(" ", F.get(name, F.lit(0)), F.get(name, F.lit(1)))).otherwise(F.get(name, F.lit(0))),
        "bed_id": F.coalesce(F.nullif(F.get(place, F.lit(2)), F.lit("")), F.nullif(F.get(place, F.lit(1)), F.lit("")), F.get(place, F.lit(0)), F.lit("")),
    })
    codes = F.create_map(*[F.lit(x) for kv in dims.CODES.items() for x in kv])

    def observation(f: Column) -> Column:
        at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))

        def of_code(code: Column) -> Column:
            c0, c1 = F.get(code, F.lit(0)), F.coalesce(F.get(code, F.lit(1)), F.lit(""))
            vital = F.when(c0.isin(dims.VITAL_NAMES), c0).otherwise(F.coalesce(F.element_at(codes, c0), F.nullif(c1, F.lit("")), c0))
            return F.struct(
                c0.alias("code"), vital.alias("vital"), clean_number(at(5)).alias("value"), at(6).alias("unit"), at(7).alias("reference_range"), at(8).alias("flag"),
                message_time(at(14)).alias("observed"), F.coalesce(F.nullif(at(11), F.lit("")), F.lit("F")).alias("status"),
            )

        return let(comp(F.get(f, F.lit(3))), of_code)

    wanted = F.filter("_fields", lambda f: (kind(f) == "OBX") & (F.size(f) >= 6) & F.get(f, F.lit(2)).isin("NM", "SN"))
    df = df.withColumn("_obs", F.filter(F.transform(wanted, observation), lambda o: o["vital"] != ""))
    # The last of each name: sorted by name and place, the one before another name; then in order of place again.
    df = df.withColumn("_sorted", F.array_sort(F.transform("_obs", lambda o, i: F.struct(o["vital"].alias("v"), i.alias("i")))))
    df = df.withColumn("_last", F.filter("_sorted", lambda x, j: F.coalesce(F.get("_sorted", j + 1)["v"] != x["v"], F.lit(True))))
    df = df.withColumn("observations", F.transform(F.array_sort(F.transform("_last", lambda x: x["i"])), lambda i: F.get("_obs", i)))
    return df.drop("_segments", "_field", "_component", "_fields", "_MSH", "_PID", "_PV1", "_name", "_place", "_time", "_obs", "_sorted", "_last")


def observations(parsed: DataFrame) -> DataFrame:
    """A row per message and vital."""
    # From a plain explode the optimizer infers a filter on the array and pushes it below every step of the parsing, each written out again.
    rows = parsed.select(*[c for c in parsed.columns if c != "observations"], F.explode_outer("observations").alias("_o")).where(F.col("_o").isNotNull())
    return rows.select("*", "_o.*").drop("_o")


def build(long: DataFrame, keys: list[str], bed_col: str, patient_col: str, time_col: str, vital_col: str, value_col: str, order_col: str) -> DataFrame:
    """Messages from long rows: ``keys`` name a message; its observations stand in the order of ``order_col``. A message's rows are few by nature."""
    stamp = F.date_format(time_col, "yyyyMMddHHmmss")
    value = F.coalesce(F.col(value_col).cast("string"), F.lit(""))
    body = F.concat_ws("|", F.lit(""), F.lit("NM"), F.concat(F.col(vital_col), F.lit("^"), F.col(vital_col)), F.lit(""), value, F.lit("unit"), F.lit(""), F.lit("N"), F.lit(""), F.lit(""), F.lit("F"), F.lit(""), F.lit(""), stamp)
    rows = long.groupBy(*keys, bed_col, patient_col).agg(F.max(time_col).alias("_sent"), F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), body.alias("b")))).alias("_obx"))
    obx = F.array_join(F.transform("_obx", lambda x, i: F.concat(F.lit("OBX|"), (i + 1).cast("string"), x["b"])), "\r")
    sent = F.date_format("_sent", "yyyyMMddHHmmss")
    head = F.concat(F.lit("MSH|^~\\&|MON|ICU|||"), sent, F.lit("||ORU^R01|"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]), F.lit("|P|2.5"))
    pid = F.concat(F.lit("PID|1||"), F.col(patient_col).cast("string"), F.lit("||LAST^FIRST"))
    pv1 = F.concat(F.lit("PV1|1|I|ICU^01^"), F.col(bed_col).cast("string"))
    return rows.select(*keys, F.concat_ws("\r", head, pid, pv1, obx).alias("message"))
