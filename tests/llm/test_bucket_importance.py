import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.llm import bucket_importance as B

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def features(t, width, buckets):
    w = words(t)
    return Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, width + 1) for k in range(len(w) - n + 1))


def brute(docs, target, percent, least, seed, width, buckets):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += features(text, width, buckets)
    for text in target:
        t += features(text, width, buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        f = features(text, width, buckets)
        w = sum(n * gain(b) for b, n in f.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, f.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(r[0], r[3], k) for k, r in enumerate(order[: len(order) * percent // 100], 1)]
    return sorted((str(r[0]), *r[1:4]) for r in rows), drawn


def made(seed, n=500):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["Der", "ß", "日本", "42"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "the very long " * 5000), (7, docs[7][1]), (7, docs[7][1]), (None, "w1 " * 30), *((1000 + i, docs[3][1] + " w1" * 25) for i in range(60))]
    return docs, [" ".join(rng.choices(vocabulary[40:], k=30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("seed", "width", "buckets", "percent"), [(1, 1, 10_000, 10), (2, 3, 130, 37), (3, 2, 1000, 100)])
def test_equals_brute_force(spark, seed, width, buckets, percent):
    docs, target = made(seed)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, weight string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = B.resample(d, t, percent, width=width, buckets=buckets).collect()
    rows, drawn = brute(docs, target, percent, 20, 2024, width, buckets)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == rows
    assert [(r.doc_id, r.score, r["rank"]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    # The draw is no bound on the weight: some are drawn with less weight than others that are not.
    if percent < 50:
        long = [r for r in got if r.n_words >= 20]
        assert min(r.weight for r in long if r["rank"]) < max(r.weight for r in long if not r["rank"])


def test_tiles_and_salts_change_nothing(spark, monkeypatch):
    docs, target = made(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    for name, value in (("TILE", 40), ("TILES_A_SALT", 2), ("COARSE", 7)):
        monkeypatch.setattr(B, name, value)
    got = B.resample(d, t).collect()
    rows, drawn = brute(docs, target, 10, 20, 2024, 1, B.BUCKETS)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == rows
    assert {(r.doc_id, r.score, r["rank"]) for r in got if r["rank"]} == set(drawn)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    t = spark.createDataFrame([], "text string")
    assert B.resample(d.limit(0), t).count() == 0
    (r,) = B.resample(d, t).collect()
    assert (r.n_features, r["rank"]) == (2, None)
    b = B.BUCKETS
    assert r.weight == 2 * math.floor(1000 * math.log((b + 2) / (2 * b)))
    (r,) = B.resample(d.withColumn("doc_id", F.lit("x")), t).collect()
    assert r.doc_id == "x"
