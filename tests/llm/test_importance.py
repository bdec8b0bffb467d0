import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import importance as I


def made(n=300, seed=1):
    rng = random.Random(seed)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(bad if i % 5 == 0 else good, k=rng.randint(20, 80))), "x") for i in range(n)]
    return docs, [(i, int(i % 5 != 0)) for i in range(0, n, 2)]


def test_weights_equal_brute_force(spark):
    docs, labels = made()
    docs += [(900, None, "x"), (901, "", "x"), (902, "one", "x"), (902, "one", "x"), (None, "g1 g2", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    l = spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, quality int")
    got = I.resample(d, l).collect()
    grams = lambda t: Counter(I.ngram_buckets([(t or "").encode()])[0].tolist())
    raw, target = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS)
    wanted = {i for i, y in labels if y}
    for i, t, _ in docs:
        for b, n in grams(t).items():
            raw[b] += n
            target[b] += n * (i in wanted and zlib.crc32(str(i).encode()) % 2 == 0)
    ratio = I.log_ratio(target, raw)
    expected = sorted((str(i), round(sum(n * ratio[b] for b, n in grams(t).items()), 6)) for i, t, _ in docs)
    assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in got) == expected
    truth = {i: i % 5 != 0 for i, _, _ in docs[:300]}
    assert np.mean([r.kept == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97


@pytest.mark.parametrize("k", [0, 1, 7, 150, 299, 300, 500])
def test_top_k_is_exact(spark, k):
    docs, labels = made()
    d, l = spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = I.resample(d, l, k=k).collect()
    best = sorted((r.perturbed for r in got), reverse=True)[:k]
    assert sorted((r.perturbed for r in got if r.kept), reverse=True) == best


def test_threshold_with_ties(spark):
    values = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7.0).alias("x"))
    v = sorted((r.x for r in values.collect()), reverse=True)
    for k in (1, 10, 500, 700, 999):
        assert I.threshold_of_top(values, "x", k) == v[k - 1]


def test_noise_is_gumbel(spark):
    g = np.array([r.g for r in spark.range(20000).select(I.gumbel(F.col("id")).alias("g")).collect()])
    assert abs(g.mean() - 0.5772) < 0.04 and abs(g.std() - 1.2825) < 0.05


def test_no_labels_and_empty_table(spark):
    docs, labels = made(30)
    d = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept and r.log_weight == 0 for r in I.resample(d, none).collect())
    assert I.resample(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
    assert I.resample(d.limit(0), none, k=3).count() == 0


def test_held_out_real_rows_of_both_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0  # neither the model nor the bound sees these
    got = I.resample(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~held)).join(labels.where(held), "doc_id")
    n = {r.quality: (r.n, r.kept) for r in got.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    print("held out (n, kept) by label:", n)
    assert n[1][1] >= 0.98 * n[1][0] and n[0][1] <= 0.1 * n[0][0]


def test_bound_parts_both_kinds():
    score, wanted = np.array([3.0, -5.0, 1.0, 2.0, -4.0, -1.0]), np.array([True, False, True, True, False, False])
    assert I.best_bound(score, wanted, 0.999) == 0.0
    assert I.best_bound(score, np.ones(6, bool), 1.0) == -5.0
    assert I.best_bound(score, np.zeros(6, bool), 0.999) == I.best_bound(np.zeros(2), np.array([True, False]), 0.999) == float("-inf")


def test_draw_equals_brute_force_and_is_no_fixed_bound(spark):
    """Texts between both kinds: the same k as a bound, other documents; and each draw is of the stated weights."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("good", k=1) + [rng.choice("gb" if rng.random() < 0.9 else "xy") + str(rng.randint(0, 99)) for _ in range(30)]) + (" g7" * rng.randint(0, 30)), "x") for i in range(600)]
    labels = [(i, int(t.count(" g") + rng.gauss(0, 6) > 29)) for i, t, _ in docs if i % 2]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in I.resample(d, l).collect()}
    score = {i: (r.log_weight + I.ROOM) / max(r.n_ngrams, 1) for i, r in got.items()}
    seen = [(score[i], y == 1) for i, y in labels if zlib.crc32(str(i).encode()) % 2]
    s, y = np.array([a for a, _ in seen]), np.array([b for _, b in seen])
    bound, length = I.best_bound(s, y, I.KEEP_TARGET), np.mean([got[i].n_ngrams for i, _ in labels if zlib.crc32(str(i).encode()) % 2])
    over = {i for i in got if score[i] >= bound}
    noise = {r.doc_id: r.g for r in d.select("doc_id", I.gumbel(F.col("doc_id").cast("string"), F.col("text")).alias("g")).collect()}
    key = {i: length * score[i] + noise[i] for i in got}
    assert all(abs(key[i] - r.perturbed) < 1e-9 for i, r in got.items())
    best = set(sorted(key, key=lambda i: -key[i])[: len(over)])
    assert {i for i, r in got.items() if r.kept} == best != over and 0 < len(over) < len(docs)


def test_target_labels_alone_and_a_very_long_text(spark):
    docs, labels = made()
    rng = random.Random(2)
    docs += [(901, " ".join(f"g{rng.randint(0, 199)}" for _ in range(300_000)), "x"), (902, " ".join(f"b{rng.randint(0, 59)}" for _ in range(300_000)), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    both = {r.doc_id: r.kept for r in I.resample(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert both[901] and not both[902]
    got = I.resample(d, spark.createDataFrame([(i, y) for i, y in labels if y], "doc_id long, quality int")).collect()
    assert all(r.kept for r in got if r.doc_id < 300 and r.doc_id % 5 and r.doc_id % 2 == 0 and zlib.crc32(str(r.doc_id).encode()) % 2)
