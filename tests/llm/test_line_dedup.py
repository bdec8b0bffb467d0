import random
import re

import pytest

from wardline.llm import line_dedup as L


def brute(rows, by):
    seen, out = {}, []
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    for has, i, t in order:
        for k, (a, b) in enumerate(L.units(t, by)):
            seen.setdefault(L.digest(t[a:b]), (has, i, t, k))
    for i, t in rows:
        t = t or ""
        found = L.units(t, by)
        own = [seen[L.digest(t[a:b])] == (i is not None, i or 0, t, k) for k, (a, b) in enumerate(found)]
        kept = [(k, a, b) for k, ((a, b), o) in enumerate(zip(found, own, strict=True)) if o]
        out.append((str(i), len(found), len(found) - len(kept), kept, ("\n" if by == "line" else "\n\n").join(t[a:b] for _, a, b in kept)))
    return sorted(out)


@pytest.mark.parametrize("by", ["line", "paragraph"])
def test_equals_brute_force(spark, by):
    rng = random.Random(2)
    pool = ["The same line", "the  SAME\tline ", "Ünïcode ﬁne", "ünïcode fine", "x", "  ", "", "long " * 3000] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)]
    rows += [(None, "The same line\nonly here"), (200, None), (201, ""), (202, "\n\n \n"), (5, rows[5][1]), (5, rows[5][1]), (6, "line 1\n\nnew one")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, unit string, rid int")
    got = sorted((str(r.doc_id), r.n_units, r.n_removed, [tuple(u) for u in r.kept], r.text) for r in L.remove_repeated_units(df, by).collect())
    assert got == brute(rows, by)
    assert L.remove_repeated_units(df.limit(0), by).count() == 0


def test_units_keep_offsets():
    t = "a\n\n b c \nd"
    assert [t[a:b] for a, b in L.units(t, "line")] == ["a", " b c ", "d"]
    assert [t[a:b] for a, b in L.units(t, "paragraph")] == ["a", " b c \nd"]
    assert not re.search(r"\S", "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in L.units(t, "line"))))


def test_unknown_unit(spark):
    with pytest.raises(ValueError):
        L.remove_repeated_units(spark.createDataFrame([], "doc_id long, text string"), "page")
