"""Records of readings: JSON lines, one per frame, to long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import engine_name, first_number, iso_time, safe_float_finite
from .snapshots import is_object, members, prepare


def load(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (order within a run of the file, rising) and ``doc`` of the lines that hold a JSON object."""
    return _lines(spark, path).where("ok").select("file", "line", "doc")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("line"), F.trim("value").alias("value"))
    return parsed(raw, "value").withColumn("ok", F.col("why").isNull())


def parsed(lines: DataFrame, value: str) -> DataFrame:
    """Adds ``doc`` and ``why`` a line is no record (null for one that is): blank, malformed, not an object."""
    prepare(lines.sparkSession)
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    doc = F.try_parse_json(text)
    why = F.when(text == "", "blank").when(doc.isNull(), "malformed").when(~is_object(doc), "not_an_object")
    return lines.withColumns({"doc": doc, "why": why})


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """How many lines were left out, by why."""
    return _lines(spark, path).where("not ok").groupBy("why").agg(F.count("*").alias("n"))


def last_records(records: DataFrame, n: int) -> DataFrame:
    return records if n <= 0 else records.orderBy(F.desc("file"), F.desc("line")).limit(n)


def times(records: DataFrame) -> DataFrame:
    """Adds ``reference_ts`` and ``reference_key``: the first of three fields that parses."""
    keys = ("capture_timestamp", "ocr_timestamp", "timestamp")
    parsed = {k: iso_time(F.try_variant_get("doc", f"$.{k}", "string")) for k in keys}
    which = F.lit(None).cast("string")
    for k in reversed(keys):
        which = F.when(parsed[k].isNotNull(), k).otherwise(which)
    return records.withColumns({"reference_ts": F.coalesce(*parsed.values()), "reference_key": which})


def cells(records: DataFrame) -> DataFrame:
    """A row per record, bed and field with its ``leaf``."""
    beds = members(records.withColumn("_beds", F.try_variant_get("doc", "$.beds", "variant")).where(is_object(F.col("_beds"))), "_beds", "bed", "_bed").where(is_object(F.col("_bed")))
    return members(beds, "_bed", "field", "leaf").where("field is not null").drop("_beds", "_bed", "doc")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def candidate(v: Column, own: Column, text: Column) -> Column:
    """Text, value, confidence and status of a candidate: an object (``own``), or a bare scalar that is its own value; ``text`` is its text."""
    value = F.coalesce(safe_float_finite(F.when(own, _text(v, "$.value")).otherwise(_text(v, "$"))), first_number(text))
    confidence = F.coalesce(safe_float_finite(_text(v, "$.confidence")), safe_float_finite(_text(v, "$.conf")))
    status = F.when(value.isNotNull(), "valid").when(F.coalesce(F.trim(text), F.lit("")) == "", "missing").otherwise("invalid")
    return F.struct(text.alias("text"), value.alias("value"), confidence.alias("confidence"), status.alias("status"))


def _first(v: Column, *paths: str) -> Column:
    """The first of the members that is there and says something (not 0, empty, false or null)."""
    def one(path: str) -> Column:
        m = F.try_variant_get(v, path, "variant")
        return F.when(~F.coalesce(F.to_json(m), F.lit("null")).isin("null", "0", "0.0", '""', "false", "{}", "[]"), m)

    return F.coalesce(*[one(p) for p in paths])


def engine_candidates(leaves: DataFrame) -> DataFrame:
    """``easy`` and ``tess`` candidates of each leaf: own members first, then ``candidates`` (an object, or a list of which the most confident of each engine counts), then the leaf as the selected engine's."""
    # Each step is a column of its own: written into one another, the steps below would repeat those above many times over.
    engine = lambda x: engine_name(F.coalesce(_text(x, "$.engine"), _text(x, "$.selected_engine"), _text(x, "$.name")))
    conf = lambda x: F.coalesce(safe_float_finite(_text(x, "$.confidence")), safe_float_finite(_text(x, "$.conf")), F.lit(-1.0))
    listed = F.transform(F.try_variant_get("leaf", "$.candidates", "array<variant>"), lambda x: F.struct(engine(x).alias("e"), conf(x).alias("c"), x.alias("x")))
    selected = F.coalesce(engine_name(_text(F.col("leaf"), "$.selected_engine")), F.lit("easy"))
    plain = F.schema_of_variant("leaf").rlike("candidates|easy:|easyocr:|tess:|tesseract:")
    df = leaves.withColumns({"_list": listed, "_flat": F.when(~plain, selected)})
    names = {"easy": ("easy", "easyocr"), "tess": ("tess", "tesseract")}
    df = df.withColumns({f"_own_{e}": F.filter("_list", lambda x: x["e"] == e) for e in names})  # noqa: B023  (called at once)
    df = df.withColumns({f"_most_{e}": F.array_max(F.transform(f"_own_{e}", lambda x: x["c"])) for e in names})

    def found(e: str, a: str, b: str) -> Column:
        from_list = F.get(F.filter(f"_own_{e}", lambda x: x["c"] == F.col(f"_most_{e}")), F.lit(0))["x"]
        flat = F.when(F.col("_flat") == e, F.col("leaf"))
        return F.coalesce(_first(F.col("leaf"), f"$.{a}", f"$.{b}"), _first(F.col("leaf"), f"$.candidates.{a}", f"$.candidates.{b}"), from_list, flat)

    df = df.withColumns({f"_v_{e}": found(e, *n) for e, n in names.items()})
    df = df.withColumns({f"_is_{e}": is_object(F.col(f"_v_{e}")) for e in names})
    df = df.withColumns({f"_t_{e}": F.when(F.col(f"_is_{e}"), _text(F.col(f"_v_{e}"), "$.text")).otherwise(_text(F.col(f"_v_{e}"), "$")) for e in names})
    df = df.withColumns({e: candidate(F.col(f"_v_{e}"), F.col(f"_is_{e}"), F.col(f"_t_{e}")) for e in names})
    return df.drop("_list", "_flat", "leaf", *[f"_{c}_{e}" for c in ("own", "most", "v", "is", "t") for e in names])
