import random

import pytest

from wardline.llm import deep_shallow, substring_dedup


def brute(texts, length):
    seen = {}
    texts = [(t or "").encode() for t in texts]
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def corpus(seed, letters="abcdef é", n=60):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choices(letters, k=k))
    passages = [piece(rng.randint(20, 220)) for _ in range(8)]
    made = []
    for _ in range(n):
        made.append("".join(rng.choice([piece(rng.randint(0, 80)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 30) :]]) for _ in range(rng.randint(0, 6))))
    return [*made, made[3], made[3], None, "", "a" * 300, "ab" * 120, "a" * 65, passages[0] * 3]


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 64, 16, 4000), (2, 64, 16, 5), (3, 50, 8, 4000), (4, 33, 32, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, length, gram, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts = corpus(seed, "ab" if seed == 3 else "abcdef é")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rid string, spans int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in substring_dedup.remove_repeats(df, length, gram).collect()}
    expected = brute(texts, length)
    for i in range(len(texts)):
        assert got[i] == expected[i], i


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(4).choices("abcdefgh", k=600))
    rows = [(1, t), (1, t), (None, t[:450]), (2, t[:100]), (2, "x" * 399)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([("1", 600, 600), ("1", 600, 600), ("None", 450, 450), ("2", 100, 0), ("2", 399, 0)])
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in substring_dedup.remove_repeats(df).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows], 400)


@pytest.mark.parametrize("seed", range(6))
def test_order(seed):
    rng = random.Random(seed)
    stem = bytes(rng.choices(b"ab", k=90))
    strings = [stem[: rng.randint(0, 90)] + bytes(rng.choices(b"abc", k=rng.randint(0, 6))) for _ in range(300)]
    for shallow in (0, 8, 32):
        assert [strings[i] for i in deep_shallow.order(strings, shallow)] == sorted(strings)
