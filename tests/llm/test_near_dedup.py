import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from wardline.llm import near_dedup
from wardline.llm.components import connected_components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0] and rows[i] == rows[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        c = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), c, c == r[0]))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(30, 200))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 20])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w[5:5] = base[0][:25]  # a shared passage
        rows.append((1000 - i, " ".join(w).replace("a ", "A\t", rng.randint(0, 3))))
    return [*rows, (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x " * 500), (8, "x " * 900), (None, "one two"), (None, "a lone null id here"), (900, rows[100][1]), (900, rows[100][1])]


@pytest.mark.parametrize("block", [2000, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, component_id string")
    got = [tuple(r) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted([tuple(r) for r in near_dedup.near_duplicates(df).collect()], key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(500, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_block_holds_its_texts_arrays_part_by_part():
    r = random.Random(4)
    words = [f"word{r.randrange(10**6)}" for _ in range(1500)]
    texts = []
    for _ in range(600):
        own = list(words)
        own[r.randrange(len(own))] = f"other{r.randrange(10**6)}"
        texts.append(" ".join(own).encode())
    n = len(texts)
    side = (np.arange(n), np.arange(n), np.full(n, 1496), np.ones((n, 64), np.int32), np.ones(n, bool))
    near_dedup.block_links(side, side, texts[:5] * (n // 5), texts, 40, 85, 5)  # tables of powers are made once
    tracemalloc.start()
    found = near_dedup.block_links(side, side, texts, texts, 40, 85, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n - 1
    shingles_bytes = 8 * 1496 * n
    assert peak < 10 * shingles_bytes, peak / shingles_bytes
