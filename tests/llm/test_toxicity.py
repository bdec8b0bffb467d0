import random
import zlib

import numpy as np
import pytest

from wardline.llm import toxicity as T


@pytest.mark.parametrize("seed", range(5))
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((i, int(rng.integers(2)), t, w / np.linalg.norm(w)))
    index = T.BlockMaxIndex.build(rows, 40)
    dense = np.zeros((700, 40))
    place = {x: k for k, x in enumerate(index.ids)}
    for i, _, t, w in rows:
        dense[place[i], t] = w
    for _ in range(50):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        near, cosine = index.nearest(t, w, 15)
        q = np.zeros(40)
        q[t] = w
        best = np.sort(dense @ q)[::-1][:15]
        assert np.allclose(cosine, best[best > 0])
        assert np.allclose(dense[near] @ q, cosine)


def made(seed=2, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(10, 60))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                w[rng.randrange(len(w))] = rng.choice(["nastyone", "vilestuff", "uglything,", "nastyoid"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = made()
    extra = [(9001, None, "y"), (9002, "", "y"), (None, "nastyone vilestuff nastyoid", "y"), (5, docs[5][1], "again"), (9003, "nastyone vilestuff " * 3000, "y")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    l = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    got = T.toxicity(d, l).collect()
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[9001][0].predicted == by[9002][0].predicted == 0 and by[9001][0].score == by[9002][0].score
    assert by[None][0].predicted == 1 and by[9003][0].predicted == 1
    assert len(by[5]) == 2 and by[5][0].score == by[5][1].score


def test_held_out_labels_change_nothing(spark):
    docs, labels = made()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in T.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_no_labels_and_empty_table(spark):
    docs, labels = made(n=30)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.toxicity(d, none).collect()} == {0.0}
    assert T.toxicity(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_all_telling_terms_are_in_the_vectors(spark):
    strong = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"][:600]  # too short for beginnings
    toxic = [[strong[(37 * i + 13 * j) % 600] for j in range(30)] + (["wea"] if i < 14 else []) for i in range(400)]
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    texts = [" ".join(w) for w in toxic] + [f"plain text {i % 7}" for i in range(1200)]
    labels = [(i, int(k < 400)) for k, i in zip(range(1600), ids, strict=False)]
    query = next(i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 5 == 0)
    docs = [(i, t) for (i, _), t in zip(labels, texts, strict=True)] + [(query, "wea")]
    got = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[query].held_out and len(got[query].evidence) == 3 and got[query].predicted == 1
    assert all(e.label == 1 and docs[[x for x, _ in labels].index(e.doc_id)][1].endswith("wea") for e in got[query].evidence)


def test_whole_query_equals_brute_force(spark):
    docs, labels = made(5, 260)
    docs += [(5001, "Nastyone, (vilestuff)! -- \"quoted\" plain", "x"), (5002, "...", "x"), (5003, docs[8][1], "x")]
    learnt = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    tok = lambda t: [w for w in (x.strip(T.AROUND) for x in t.encode().lower().split()) if w]
    text = {i: tok(t) for i, t, _ in docs}
    terms = {w for i in learnt for w in text[i]}
    df = {w: sum(w in set(x) for x in text.values()) for w in terms}
    n = [sum(1 for y in learnt.values() if y == k) for k in (0, 1)]

    def weight(w):
        a, b = (sum(1 for i, y in learnt.items() if y == k and w in text[i]) + 0.5 for k in (1, 0))
        c, d = n[1] + 1 - a, n[0] + 1 - b
        return (np.log((1 + len(docs)) / (1 + df[w])) + 1) * (1 + max(0, np.log(a * d / b / c) - 2 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) ** 2)

    weights = {w: weight(w) for w in terms}

    def vector(ws):
        v = {w: (1 + np.log(ws.count(w))) * weights[w] for w in set(ws) if w in terms}
        return {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    vectors = {i: vector(text[i]) for i in text}
    got = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    share = n[1] / sum(n)
    for i in text:
        near = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), y) for j, y in learnt.items()), reverse=True)[:15]
        votes = [(c * c / (1.0001 - min(c, 1)), y) for c, y in near if c > 0]
        expected = (sum(v for v, y in votes if y) + 0.1 * share) / (sum(v for v, _ in votes) + 0.1)
        assert abs(got[i].score - expected) < 2e-3 * max(1, expected), i
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert got[5002].score == share and not got[5002].evidence


def test_held_out_rows_of_the_shared_tables(spark):
    d = "/root/testdata/sf0.1"
    rows = T.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("held_out").select("doc_id", "predicted").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    own = [(r.predicted, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]
    toxic, clean = [p for p, y in own if y], [p for p, y in own if not y]
    print("held out: found", sum(toxic), "of", len(toxic), "false alarms", sum(clean), "of", len(clean))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
