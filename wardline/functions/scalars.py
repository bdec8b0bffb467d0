"""Scalar functions as column expressions; none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NOT_FINITE = r"^[+-]?(inf|infinity|nan)$"
TOKYO = "Asia/Tokyo"


def safe_float(c: Column) -> Column:
    """A text's number, or null: digits with sign, point and exponent, or the names of infinity and not-a-number; spaces around do not matter. Underscores and type suffixes are no numbers."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER) | F.lower(t).rlike(NOT_FINITE), t.try_cast("double"))


def safe_float_finite(c: Column) -> Column:
    x = safe_float(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_number(c: Column) -> Column:
    """What is left of a text without all but digits, points and signs, as a number: ``12/80`` is 1280, ``1-2`` none."""
    return safe_float(F.regexp_replace(c, r"[^\d.\-+]", ""))


def first_number(c: Column) -> Column:
    """The first number in a text once commas are gone."""
    return safe_float_finite(F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")))


def canonical_number(x: Column) -> Column:
    """A number as text without trailing zeros; whole numbers without a point."""
    whole = x == F.floor(x)
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", ""))


def is_whole(x: Column) -> Column:
    return x == F.floor(x)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0)


def one_decimal(x: Column) -> Column:
    """One digit after the point, halves to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def display_value(vital: Column, x: Column) -> Column:
    """What a screen shows: ``....`` for nothing, one decimal for temperatures, whole numbers for the rest."""
    return F.when(x.isNull() | F.isnan(x), F.lit("....")).when(vital.isin(dims.DECIMAL_DISPLAY), one_decimal(x)).otherwise(F.bround(x, 0).cast("bigint").cast("string"))


def display_candidates(vital: Column, x: Column) -> Column:
    return F.array(display_value(vital, x))


def shorter_texts(text: Column, drop_decimals: bool = True) -> Column:
    """Ever shorter forms of a text, without repeats: itself, its rounded number, its first four characters."""
    x = safe_float(text)
    options = [text] + [F.when(x.isNotNull(), F.bround(x, 0).cast("bigint").cast("string"))] * drop_decimals + [F.substring(text, 1, 4)]
    return F.array_distinct(F.array_compact(F.array(*options)))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def engine_name(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("easy", "easyocr"), "easy").when(t.isin("tess", "tesseract", "tesseractocr"), "tess")


def file_token(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_")


def csv_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def message_time(c: Column) -> Column:
    """``yyyyMMdd``, with ``HHmm`` and ``ss`` if there, as a zoneless time; a zone at the end is dropped; null if no such time exists."""
    t = F.regexp_replace(F.trim(c), r"[+-]\d{4}$", "")
    # Of 14 characters and more the first 14 count, of 12 the first 12, of 8 the first 8: all must be digits.
    digits = F.concat(*[F.regexp_extract(t, r"(?s)^(?:(\d{14}).*|(\d{12}).?|(\d{8}).{0,3})$", i) for i in (1, 2, 3)])
    iso = F.regexp_replace(F.rpad(digits, 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")
    return iso.try_cast("timestamp_ntz")


def shown_time(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` (parts may lack a leading zero) or ``yyyyMMddHHmmss`` as a zoneless time; null for anything else, and where no such time exists."""
    packed = F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6")
    parts = [F.lpad(F.regexp_extract(packed, r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", i), 4 if i == 1 else 2, "0") for i in range(1, 7)]
    iso = F.format_string("%s-%s-%s %s:%s:%s", *parts)
    return F.when(packed.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), iso.try_cast("timestamp_ntz"))


def iso_time(c: Column, zone: str = "+09:00") -> Column:
    """An ISO 8601 time as an instant: ``Z``, an offset, or none (then ``zone`` holds); null for anything else."""
    t = F.regexp_replace(F.trim(c), r"[zZ]$", "+00:00")
    full = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$")
    zoned = F.when(t.rlike(r"[+-]\d{2}:\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(f"T00:00:00{zone}"))).otherwise(F.concat(t, F.lit(zone)))
    return F.when(full, F.replace(zoned, F.lit(" "), F.lit("T")).try_cast("timestamp"))


def tokyo_iso(ts: Column) -> Column:
    """An instant as ISO text in Tokyo time, whatever the session's zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(TOKYO), F.to_utc_timestamp(ts, F.current_timezone()).cast("timestamp_ntz"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, to the microsecond; works for zoneless times too."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def mismatch_tolerance(vital: Column, a: Column, b: Column) -> Column:
    fine = vital.isin(dims.TEMPERATURES) | ~is_whole(a) | ~is_whole(b)
    return F.when(fine, 0.2).otherwise(1.0)


def invalid_reason(text: Column, value: Column) -> Column:
    """Why a reading has no value: it is empty, or not a number."""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(value.isNull(), F.when(empty, F.lit("empty")).otherwise(F.concat(F.lit("invalid_numeric:"), text)))
