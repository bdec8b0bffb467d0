"""Texts read off a screen to numbers, as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

#: Full-width digits, point, minus and slash, and their plain forms.
PLAIN = "0123456789.-/"
FULL_WIDTH = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)


@functools.cache
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form (NFKC) holds characters that any reading may have: those with one of them, and those with several.

    Only what may stay is kept of a form. A sequence folds as its characters do: nothing of PLAIN is
    composed with what stands beside it.
    """
    one, more = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if (form := "".join(x for x in unicodedata.normalize("NFKC", c) if x in PLAIN)) and form != c:
            (one if len(form) == 1 else more)[c] = form
    return one, more


def folded(text: Column) -> Column:
    """``text`` with the compatibility forms of such characters, what of them no reading may have left out: one translation, and a look-up by character where some have forms of several."""
    one, more = foldings()
    table = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    by_character = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    longer = F.when(text.rlike(f"[{''.join(more)}]"), by_character).otherwise(text)
    return F.translate(longer, "".join(one), "".join(one.values()))


def allowlist(vital: Column) -> Column:
    own = F.create_map(*[F.lit(x) for kv in dims.ALLOWED_CHARACTERS.items() for x in kv])
    return F.coalesce(F.element_at(own, vital), F.lit(dims.DEFAULT_CHARACTERS))


def well_formed(vital: Column, text: Column) -> Column:
    """Whether the text has the form of the vital's readings (any number where it has none of its own)."""
    tests = F.when(vital == "", F.lit(None).cast("boolean"))
    for v, pattern in dims.PATTERNS.items():
        tests = tests.when(vital == v, text.rlike(pattern))
    return tests.otherwise(text.rlike(r"^[0-9]+$"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: plans stay small where expressions nest."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def one_point(text: Column, mark: str = ".") -> Column:
    """Only the first of several marks stays."""

    def rest(t: Column) -> Column:
        head = F.substring_index(t, mark, 1)
        return F.when(F.contains(t, F.lit(mark)), F.concat(head, F.lit(mark), F.replace(F.substring(t, F.length(head) + 2, F.length(t)), F.lit(mark), F.lit("")))).otherwise(t)

    return let(text, rest)


def normalized(vital: Column, text: Column) -> Column:
    """Compatibility forms of characters, no spaces, only what the vital allows, one point."""
    plain = F.replace(folded(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit(""))
    other = F.when(vital.isin("CVP_M", "RAP_M"), r"[^0-9.\-]").when(vital.isin("TSKIN", "TRECT"), "[^0-9.]").otherwise("[^0-9]")
    return one_point(F.regexp_replace(plain, other, F.lit("")))


def digits_like(vital: Column, text: Column) -> Column:
    """As ``normalized``; where that leaves nothing, the letter O counts as 0. A point at an end is dropped or given its 0."""

    def mended(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^-?[0-9]+\.$"), F.regexp_replace(t, r"\.$", ""))
            .when(t.rlike(r"^\.[0-9]+$"), F.concat(F.lit("0"), t))
            .when(t.rlike(r"^-\.[0-9]+$"), F.concat(F.lit("-0"), F.substring(t, 2, 100)))
            .otherwise(t)
        )

    zeros = normalized(vital, F.translate(F.coalesce(text, F.lit("")), "Oo", "00"))
    return let(F.coalesce(F.nullif(normalized(vital, text), F.lit("")), zeros), mended)


def sanitized(text: Column) -> Column:
    return one_point(F.regexp_replace(F.trim(text), "[^0-9.]", ""))


def in_range(vital: Column, x: Column) -> Column:
    """Within the vital's bounds, which it may not have."""
    low = F.create_map(*[F.lit(y) for v, (a, _) in dims.VALID_RANGES.items() for y in (v, a)])
    high = F.create_map(*[F.lit(y) for v, (_, b) in dims.VALID_RANGES.items() for y in (v, b)])
    return F.coalesce(x.between(F.element_at(low, vital), F.element_at(high, vital)), x.isNotNull())


def _whole_if_preferred(vital: Column, x: Column) -> Column:
    return F.when(vital.isin(dims.INTEGER_PREFERRED), F.bround(x, 0)).otherwise(x)


def _accepted(vital: Column, number: Column) -> Column:
    """A number rounded where the vital wants whole ones, if it is in bounds then."""
    return let(_whole_if_preferred(vital, number), lambda x: F.when(in_range(vital, x), x))


def parsed_number(vital: Column, text: Column) -> Column:
    """A reading's number: temperatures of three digits have a point before the last; values out of bounds are tried as they stand, then given up."""

    def tried(s: Column) -> Column:
        number = F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))
        tenths = F.when(vital.isin(dims.TEMPERATURES) & s.rlike(r"^\d{3}$"), F.concat(F.substring(s, 1, 2), F.lit("."), F.substring(s, 3, 1)).cast("double"))
        return F.coalesce(_accepted(vital, tenths), _accepted(vital, number))

    return let(sanitized(text), tried)


def parsed_reading(vital: Column, text: Column) -> Column:
    """As a candidate is parsed: no fractions, a minus only in front; what is a number counts as such, other texts by ``parsed_number``."""

    def tried(t: Column) -> Column:
        is_number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
        value = F.when(is_number, _accepted(vital, t.try_cast("double"))).otherwise(parsed_number(vital, t))
        minus = F.length(t) - F.length(F.replace(t, F.lit("-"), F.lit("")))
        return F.when(~F.contains(t, F.lit("/")) & ((minus == 0) | ((minus == 1) & t.startswith("-"))), value)

    return let(F.trim(text), tried)


def failed_reading(text: Column, value: Column, method: Column, confidence: Column, least: float, exception: Column, all_empty: Column) -> Column:
    """Why a reading is kept for inspection, or null: the first reason that holds."""
    return (
        F.when((text == "") | value.isNull(), "empty")
        .when(method.isin("no_match", "fallback_tesseract"), method)
        .when(F.coalesce(confidence, F.lit(0.0)) < least, "low_conf")
        .when(exception, "exception")
        .when(all_empty, "parse_fail")
    )


def all_passes_empty(passes: Column) -> Column:
    """Whether there are passes (lists by name) and none of them found anything."""
    return (F.size(passes) > 0) & F.forall(F.map_values(passes), lambda found: F.coalesce(F.array_size(found), F.lit(0)) == 0)
