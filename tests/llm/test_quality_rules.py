import re
from collections import Counter

import pytest

from wardline.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


CASES = [
    None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x " * 40, "l1\nl1\n\n\nl1 \nl1",
    "é ü 漢字\x0bfoo\x0cbar\rbaz\x85qux nb", "#|$ <a> & % * \U0001f600 😀", "q " * 3 + "one two three four five six seven eight nine " * 3,
    " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(5, 30)), "\x1c\x1d words\x1e",
]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i


def test_null_id_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "the of and " * 20), (1, None), (1, None)], schema)
    assert sorted((r.doc_id is None, r.kept) for r in Q.quality_rules(df).collect()) == [(False, False), (False, False), (True, False)]
    assert Q.quality_rules(spark.createDataFrame([], schema)).count() == 0


def test_table_decides(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "### ### ###")], "doc_id long, text string")
    rules = (Q.Rule("symbol_word_ratio", high=0.5),)
    assert {r.doc_id: (r.kept, r.broken_rules) for r in Q.quality_rules(df, rules).collect()} == {1: (True, []), 2: (False, ["symbol_word_ratio"])}


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    plan = Q.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("name", ["n_words", "repeat_word_ratio"])
def test_rules_name_measures(name):
    assert name in Q.MEASURES and all(r.measure in Q.MEASURES for r in Q.RULES)


def test_query_equals_sql(spark):
    import duckdb

    from wardline.llm import registry

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as from '{d}/documents.parquet'")
    df = registry.QUERIES["op7_quality_rules"](spark, d)
    expected = c.sql(registry.SQL["op7_quality_rules"])
    assert expected.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(expected.fetchall())
