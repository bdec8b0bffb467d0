import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import block_max as M
from wardline.llm.terms import Terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return PATTERN.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, best):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for q, text in queries:
        found = []
        for i, c, size in own:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, k in Counter(terms(text)).items() if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:best], 1)]
    return out


def made(seed, n=700):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    text = lambda k: " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(k))
    docs = [(i, text(rng.randint(0, 80))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "c1 LONG " * 4000), (5, docs[5][1]), (5, docs[5][1]), (None, docs[9][1]), *((2000 + i, docs[11][1]) for i in range(40))]
    queries = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(90, docs[11][1]), (91, None), (92, "nowhere"), (93, "c1 C1 long"), (94, docs[9][1])]
    return docs, queries


@pytest.mark.parametrize(("seed", "shard"), [(1, 4096), (2, 90)])
def test_equals_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(M, "SHARD", shard)
    docs, queries = made(seed)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    for best in (20, 3):
        got = [tuple(r) for r in M.ranked(d, q, best).orderBy("item_id", "rank").collect()]
        assert got == brute(docs, queries, best)


def test_query_blocks_change_nothing(spark, monkeypatch):
    docs, queries = made(3, 200)
    monkeypatch.setattr(M, "QUERIES", 4)
    monkeypatch.setattr(M, "QUERY_TERMS", 50)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert [tuple(r) for r in M.ranked(d, q).orderBy("item_id", "rank").collect()] == brute(docs, queries, 20)


def test_empty_sides(spark):
    d, q = spark.createDataFrame([("a", "x y")], "doc_id string, text string"), spark.createDataFrame([(1, "y")], "item_id int, text string")
    assert M.ranked(d.limit(0), q).count() == 0 and M.ranked(d, q.limit(0)).count() == 0
    assert M.ranked(d, q.limit(0)).columns == M.ranked(d, q).columns
    assert [tuple(r)[:3] for r in M.ranked(d, q).collect()] == [(1, 1, "a")]
    assert M.ranked(d.withColumn("text", F.lit(None).cast("string")), q).count() == 0


def shard_of(texts, docs, total):
    t = Terms([x.encode() for x in texts])
    made = M.build(t.hashes(), t.of_text(), len(texts), docs, total)
    return M.Shard(*(np.frombuffer(np.asarray(getattr(made, c)).astype(k).tobytes(), k) for c, k in M.ARRAYS.items()))


def test_blocks_round_trip():
    rng = random.Random(4)
    texts = [" ".join(["every"] * rng.choice([1, 3, 300, 70_000 if i == 9 else 2]) + ["some"] * (i % 3 == 0) + [f"own{i}"]) for i in range(700)]
    total = sum(len(x.split()) for x in texts)
    s = shard_of(texts, len(texts), total)
    assert s.count.max() == M.BLOCK and s.widths.max() > 1
    doc, tf, which = s.unpack(np.arange(len(s.count)))
    found = Counter()
    term = np.repeat(np.arange(len(s.terms)), np.diff(s.term_blocks))
    for d, n, b in zip(doc, tf, which, strict=True):
        found[(int(s.terms[term[b]]), int(d))] = int(n)
    hashes = dict(zip(["every", "some"], Terms([b"every some"]).hashes().tolist(), strict=True))
    for w, h in hashes.items():
        for i, x in enumerate(texts):
            assert found.get((h, i), 0) == x.split().count(w)
    assert len(found) == sum(len(set(x.split())) for x in texts)
    # Bounds are the greatest impacts of their blocks.
    most = np.zeros(len(s.count), np.int64)
    np.maximum.at(most, which, M.impacts(tf, s.lengths[doc], len(texts), total))
    assert (most == s.most).all()


def test_blocks_are_skipped():
    """A passage that some documents hold whole: most postings of common terms are never unpacked, and the result is whole."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(30)]
    passage = " ".join(f"p{k} c{k % 30}" for k in range(20))
    texts = [" ".join(rng.choices(common, k=60)) + (" " + passage if 1000 <= i < 1030 else "") for i in range(4000)]
    total = sum(len(x.split()) for x in texts)
    s = shard_of(texts, len(texts), total)
    h, n = np.unique(Terms([passage.encode()]).hashes(), return_counts=True)
    df = Counter(w for x in texts for w in set(x.split()))
    by_hash = {int(Terms([w.encode()]).hashes()[0]): w for w in df}
    w = np.array([M.weight(len(texts), df[by_hash[int(x)]]) for x in h]) * n
    place = np.searchsorted(s.terms, h)
    query, seen, ids = M.Query(np.arange(len(h)), w), Counter(), pa.array(range(4000))
    M.search(s, ids, place, query, len(texts), total, seen)
    assert {i for _, _, i in query.found} <= set(range(1000, 1030)) and len(query.found) == M.BEST
    assert seen["unpacked"] < 0.25 * seen["postings"]
    # Searched again with the threshold reached, almost nothing is unpacked but the short lists.
    again = Counter()
    M.search(s, ids, place, query, len(texts), total, again)
    assert again["unpacked"] <= seen["unpacked"]
