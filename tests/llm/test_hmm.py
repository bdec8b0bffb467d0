import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import hmm


def model(k=4, classes=12, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)) ** 3, 1), norm(rng.random((classes, k)) ** 4, 0))


def naive(m, ids):
    total, x = 0.0, m.start.copy()
    for t, i in enumerate(ids):
        x = (x if t == 0 else x @ m.step) * m.emit[i]
        total += math.log10(x.sum())
        x = x / x.sum()
    return total


@pytest.mark.parametrize("k", [1, 3])
def test_forward_in_segments_is_exact(k):
    m, rng = model(k), np.random.default_rng(1)
    ids = [rng.integers(0, 12, n) for n in (0, 1, 2, 255, 256, 257, 512, 3000, 5)]
    assert np.allclose(m.log10s(ids), [naive(m, x) for x in ids], rtol=1e-10)


def test_all_sequences_sum_to_one():
    m = model(2, 3)
    ids = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    assert np.isclose((10 ** m.log10s(ids)).sum(), 1)


def test_expected_counts_equal_enumeration():
    m = model(2, 3)
    ids = np.array([0, 2, 1, 1])
    starts, steps, emits, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = m.start[path[0]] * m.emit[ids[0], path[0]]
        for t in range(1, 4):
            p *= m.step[path[t - 1], path[t]] * m.emit[ids[t], path[t]]
        total += p
        starts[path[0]] += p
        for t in range(4):
            emits[ids[t], path[t]] += p
            if t:
                steps[path[t - 1], path[t]] += p
    got = m.expected([ids])
    for a, b in zip(got, (starts, steps, emits), strict=True):
        assert np.allclose(a, b / total)
    both = m.expected([ids, ids[:2], ids[:0]])
    one = m.expected([ids[:2]])
    for a, b, c in zip(got, one, both, strict=True):
        assert np.allclose(a + b, c)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    languages = [[f"{p}{i}" for i in range(300)] for p in ("ka", "lo", "mi")]
    return [(i, " ".join(rng.choices(rng.choice(languages), k=rng.randint(5, 80))), "x") for i in range(n)]


def test_scores(spark):
    rows = [*corpus(), (9001, None, "y"), (9002, "", "y"), (None, "never seen", "y"), (4, "KA1 ka1\x0bka2", "again"), (9003, "ka1 " * 4000, "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = hmm.score(d, words=200, states=3).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t, _ in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    expected = sorted(
        (str(i), held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 5)) for i, t, _ in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_one_state_is_the_class_unigram_model(spark):
    """With one state and no rounds, the score is the class's share times the word's share in it: a distribution over words."""
    d = spark.createDataFrame(corpus(60), "doc_id long, text string, score string")
    for r in hmm.score(d, words=2000, states=1, rounds=0).collect():
        assert abs(r.score - r.base_score) < 0.05 * abs(r.base_score) + 0.5


def test_no_training_rows_and_empty_table(spark):
    d = spark.createDataFrame([r for r in corpus(100) if zlib.crc32(str(r[0]).encode()) % 10 == 0], "doc_id long, text string, score string")
    got = hmm.score(d).collect()
    assert got and all(r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(d.limit(0)).count() == 0
