"""Two engines on the same readings: winners, statistics by field and over all, confusion of digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_number
from .quantiles import quantiles


def winner(easy_error: Column, tess_error: Column) -> Column:
    return (
        F.when(easy_error.isNull() & tess_error.isNull(), "none")
        .when(tess_error.isNull() | (easy_error < tess_error), "easy")
        .when(easy_error.isNull() | (tess_error < easy_error), "tess")
        .otherwise("tie")
    )


def compared(df: DataFrame) -> DataFrame:
    """Rows with a truth, with the engines' errors, matches (within ``tol``) and ``winner``. Wants ``truth``, ``easy_value``, ``tess_value``, ``tol``."""
    df = df.where("truth is not null and not isnan(truth)")
    for e in ("easy", "tess"):
        df = df.withColumn(f"{e}_abs_err", F.abs(F.col(f"{e}_value") - F.col("truth"))).withColumn(f"{e}_match", F.coalesce(F.col(f"{e}_abs_err") <= F.col("tol"), F.lit(False)))
    return df.withColumn("winner", winner(F.col("easy_abs_err"), F.col("tess_abs_err")))


def summary(df: DataFrame, field: str = "field", digits: int = 6) -> DataFrame:
    """One aggregate over the grouping sets (field) and (): ``field`` is null in the row over all.

    A reading without a value is missing, or invalid where ``easy_text`` or ``tess_text`` says something
    (both columns are optional). ``match_rate`` is that of both engines together.
    """
    r = lambda c: F.round(c, digits)
    rate = lambda c: r(F.try_divide(F.count_if(c), F.count("*")))
    says = lambda e: F.coalesce(F.trim(F.col(f"{e}_text")) != "", F.lit(False)) if f"{e}_text" in df.columns else F.lit(False)
    stats = [F.count("*").alias("n")] + [F.count_if(F.col("winner") == w).alias(name) for w, name in (("easy", "easy_win"), ("tess", "tess_win"), ("tie", "tie"), ("none", "both_bad"))]
    stats.append(r((F.count_if("easy_match") + F.count_if("tess_match")) / (2 * F.count("*"))).alias("match_rate"))
    for e in ("easy", "tess"):
        none = F.col(f"{e}_value").isNull()
        stats += [
            r(F.avg(f"{e}_abs_err")).alias(f"{e}_mae"), rate(F.col(f"{e}_match")).alias(f"{e}_match_rate"),
            rate(none & ~says(e)).alias(f"{e}_missing_rate"), rate(none & says(e)).alias(f"{e}_invalid_rate"),
        ]
    win_error = F.when(F.col("winner") == "tess", F.col("tess_abs_err")).otherwise(F.col("easy_abs_err"))
    df = df.withColumn("_win", win_error)
    rows = df.groupingSets([[field], []], field).agg(*stats, r(F.avg("_win")).alias("winner_mae"), F.grouping(field).alias("_all"))
    medians = quantiles(df, "_win", {"_m": 0.5}, [field]).select(F.col(field).alias("_f"), F.lit(0).alias("_a"), "_m").union(quantiles(df, "_win", {"_m": 0.5}).select(F.lit(None), F.lit(1), "_m"))
    rows = rows.join(medians, F.col(field).eqNullSafe(F.col("_f")) & (F.col("_all") == F.col("_a")), "left")
    return rows.withColumn("winner_median", r(F.col("_m"))).drop("_all", "_f", "_a", "_m")


def digit_confusion(df: DataFrame, truth: str = "truth", read: str = "read", *by: str) -> DataFrame:
    """How often each digit of the truth was read as each digit of the text read; only digits count, aligned at the left, the shorter row of them padded with ``_``. Rows read as null are left out."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    pairs = df.where(F.col(truth).isNotNull() & F.col(read).isNotNull()).select(*by, digits(canonical_number(F.col(truth))).alias("_a"), digits(F.col(read)).alias("_b"))
    n = F.greatest(F.length("_a"), F.length("_b"))
    at = lambda c, i: F.coalesce(F.nullif(F.substring(F.col(c), i, F.lit(1)), F.lit("")), F.lit("_"))
    places = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at("_a", i).alias("truth_digit"), at("_b", i).alias("pred_digit"))))
    return pairs.select(*by, F.explode(places).alias("p")).groupBy(*by, "p.truth_digit", "p.pred_digit").agg(F.count("*").alias("count"))


def joined_tokens(df: DataFrame, keys: list[str], order: str, text: str, confidence: str) -> DataFrame:
    """A reading's tokens joined in order, and the mean of their confidences (percent; negative ones are none) as a share."""
    mean = F.avg(F.when(F.col(confidence) >= 0, F.col(confidence))) / 100
    parts = F.array_sort(F.collect_list(F.struct(order, text)))  # of one reading
    return df.groupBy(*keys).agg(mean.alias("confidence"), F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text"))


def routed(easy: Column, tess: Column, mode: Column, low: float, fallback: Column, wanted: Column, compare: Column) -> Column:
    """Which engine reads a field, whether the second one runs, and the value: ``selected``, ``tess_ran``, ``value``.

    ``easy`` and ``tess`` are structs of ``text``, ``value``, ``conf`` and (``easy``) ``failed`` (a pass went wrong, or all were empty), null
    where an engine found nothing. ``mode``: "easyocr" (the second engine only where the first is of no use and
    ``fallback`` allows), "tesseract", or "both" (the second for ``wanted`` fields, and taken only where the first is of no use).
    ``compare`` runs both always. The first is of no use without text or value, after a failure, or under confidence ``low``.
    """
    none = lambda c: F.coalesce(c, F.lit(True))
    useless = easy.isNull() | none(easy["text"] == "") | easy["value"].isNull() | none(easy["failed"]) | none(easy["conf"] < low)
    ran = compare | (mode == "tesseract") | ((mode == "both") & wanted) | ((mode == "easyocr") & fallback & useless)
    second = ran & tess.isNotNull()
    takes = F.when(mode == "tesseract", True).when(mode == "both", useless & second).otherwise(second)
    return F.struct(
        F.when(takes, "tesseract").otherwise("easyocr").alias("selected"), ran.alias("tess_ran"), F.when(takes, F.when(second, tess["value"])).otherwise(easy["value"]).alias("value")
    )


def best_variant(df: DataFrame, keys: list[str], place: str, text: str = "text", value: str = "value", confidence: str = "confidence", variant: str = "variant") -> DataFrame:
    """Of each key's variants the most confident with a value, else the most confident at all; the first by ``place`` of equals.

    Negative confidences count for nothing: a key with no others has an empty text, confidence 0 and variant
    "normal". Partial maxima, no sort.
    """
    own = F.struct(F.col(text).alias("text"), F.col(value).alias("value"), F.col(confidence).alias("confidence"), F.col(variant).alias("variant"))
    rank = lambda c: F.when(c & (F.col(confidence) >= 0), F.struct(F.col(confidence), -F.col(place)))
    best = df.groupBy(*keys).agg(F.max_by(own, rank(F.col(value).isNotNull())).alias("_valid"), F.max_by(own, rank(F.lit(True))).alias("_any"))
    nothing = F.struct(F.lit("").alias("text"), F.lit(None).cast(df.schema[value].dataType).alias("value"), F.lit(0).cast(df.schema[confidence].dataType).alias("confidence"), F.lit("normal").alias("variant"))
    return best.select(*keys, F.coalesce("_valid", "_any", nothing).alias("_b")).select(*keys, "_b.*")
