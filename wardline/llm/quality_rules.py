"""Quality rules: a table of thresholds compiled into Spark column expressions.

Every measure and every verdict is a built-in Spark expression: no user function runs, and one
pass over the documents with no shuffle gives the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators: space and \t \n \v \f \r.
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages of the corpus; found as whole words between spaces.
STOP_WORDS = "the of and to in is that for de la le les et un que der die und den von el los en".split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when its measure is below ``low`` or above ``high``."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are shares (0 to 1), except symbols, which are counted per word.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_word_ratio", high=0.30),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_word_ratio", high=0.20),
    Rule("dup_line_ratio", high=0.50),
    Rule("distinct_stop_words", low=2),
)


def measures(text: Column) -> list[list[tuple[str, Column]]]:
    """Layers of named columns; a layer uses the names of those before it."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^ \\t-\\r]"))
    count = lambda c: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / len(c)
    pair = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    head = lambda c, k: F.slice(c, 1, F.greatest(F.size(c) - k, F.lit(0)))
    col = F.col
    return [
        [("_words", words), ("_lines", lines)],
        # A window's hash is built by doubling: of 1, 2, 4, then 8 words. Tails that have no partner are cut.
        [("_h2", head(pair(col("_words"), 1), 1))],
        [("_h4", head(pair(col("_h2"), 2), 2))],
        [("_h8", head(pair(col("_h4"), 4), 4))],
        [
            # Only texts with a repeated window sort theirs: equal hashes become neighbours, each with its place.
            (
                "_places",
                F.when(
                    F.size(F.array_distinct("_h8")) < F.size("_h8"),
                    F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                ),
            ),
        ],
        [
            (
                "_repeated",
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                F.col("_places"),
                                lambda p, k: F.struct(
                                    p["i"].alias("i"),
                                    (
                                        F.coalesce(F.get(col("_places"), k - 1)["h"] == p["h"], F.lit(False))
                                        | F.coalesce(F.get(col("_places"), k + 1)["h"] == p["h"], F.lit(False))
                                    ).alias("again"),
                                ),
                            ),
                            lambda p: p["again"],
                        ),
                        lambda p: p["i"],
                    )
                ),
            ),
        ],
        [
            ("n_words", F.size("_words").cast("long")),
            ("word_chars", (F.length(text) - sum(count(c) for c in " \t\n\v\f\r")).cast("long")),
            ("n_symbols", sum(count(c) for c in SYMBOLS).cast("long")),
            ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
            (
                "n_repeat_words",
                # Windows cover eight words each, less what the next repeated window covers too.
                F.coalesce(
                    F.aggregate(
                        F.zip_with(
                            "_repeated",
                            F.slice("_repeated", 2, F.greatest(F.size("_repeated"), F.lit(1))),
                            lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
                        ),
                        F.lit(0),
                        lambda s, x: s + x,
                    ),
                    F.lit(0),
                ).cast("long"),
            ),
            ("_n_lines", F.size("_lines")),
            ("distinct_stop_words", sum(F.contains(text, F.lit(f" {w} ")).cast("int") for w in STOP_WORDS)),
        ],
        [
            ("mean_word_chars", F.try_divide(col("word_chars"), col("n_words"))),
            ("symbol_word_ratio", F.try_divide(col("n_symbols"), col("n_words"))),
            ("dup_line_ratio", F.try_divide(col("n_dup_lines"), col("_n_lines"))),
            ("repeat_word_ratio", F.try_divide(col("n_repeat_words"), col("n_words"))),
        ],
    ]


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distinct_stop_words",
    "mean_word_chars", "symbol_word_ratio", "dup_line_ratio", "repeat_word_ratio",
)


def broken(rule: Rule) -> Column:
    """Whether a row breaks the rule; a measure that is null (a ratio of nothing) breaks none."""
    m = F.col(rule.measure)
    tests = [m < rule.low] * (rule.low is not None) + [m > rule.high] * (rule.high is not None)
    return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, all measures, ``broken_rules`` (names, in the table's order) and ``kept``.

    Null and empty texts have no words and fail any lower bound on ``n_words``. Repeated rows are
    measured each for itself; columns besides id and text are not read, so their names cannot clash.
    An empty table gives no rows.
    """
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for layer in measures(F.col("_text")):
        out = out.select(*[c for c in out.columns], *[c.alias(n) for n, c in layer])
    verdict = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.measure)) for r in rules])) if rules else F.array().cast("array<string>")
    out = out.select(id_col, *MEASURES, verdict.alias("broken_rules"))
    return out.withColumn("kept", F.size("broken_rules") == 0)
