import random

import pytest

import corpus_pipeline as P

D = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    assert P.ORACLE_SQL is None


def test_stages_on_real_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, D)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] <= counts[5]
    assert sorted(map(str, P.run(spark, D).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, k):
    extra = [(None, None, "en", 1, 2), (1, None, "en", 1, 2), (2, "", "en", 1, 2), (3, "a b", None, 1, 2), (3, "a b", None, 1, 2), (4, "long " * 5000, "en", 1, 2), (5, "the of and " * 30 + "é" * 500, "en", 1, 2)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, kept string, n_chars long, score int")
    out = P.STAGES[k][1](spark, docs, D)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5}
        if k == 2:
            assert len(rows) == 6
        if k == 3:
            assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows if r.doc_id in (4, 5))
    assert P.STAGES[k][1](spark, docs.limit(0), D).count() == 0


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(8)
    words = lambda n, k: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(k, k + 4))) for _ in range(n))
    long, short, scattered = words(51, 2), words(40, 8), words(60, 3)
    rows = []
    for i in range(30):
        own = [words(80, 3), words(70, 3)]
        rows.append((i, own[0] + " " + (long if i < 10 else short if i < 20 else scattered if i == 20 else "") + " " + own[1], own))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(30, rows[20][1])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.cut_repeats(spark, docs, D).collect()}
    for i, text, own in rows:
        if i < 10:
            assert long not in got[i] and got[i].startswith(own[0].rpartition(" ")[0]) and got[i].endswith(own[1].partition(" ")[2])
            assert len(got[i].split()) in (149, 150)
        elif i != 20:
            assert got[i] == text
    assert got[20] == got[30] == ""


def test_rows_of_one_id_and_packed_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (5, b), (3, a.replace("a7 ", "")), (5, a.upper()), (4, b + " end")]
    kept = sorted((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect())
    assert kept == [(3, rows[3][1]), (4, rows[5][1])]
    packed = P.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    assert all(len(r.ids) == 4 * r.length for r in packed) and len(packed) == 6


def test_half_characters_go(spark):
    from wardline.llm.substring_dedup import whole_characters

    rows = [("aé漢😀b".encode()[:n],) for n in range(12)] + [("aé漢😀b".encode()[n:],) for n in range(12)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(whole_characters("b").alias("t")).collect()]
    assert got == [b.decode("utf-8", "ignore") for (b,) in rows]


def test_near_dedup_stage_equals_brute_force_at_80(spark):
    from tests.llm.test_near_dedup import brute, shingle_set

    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 300))]
        rows.append((2 * i, " ".join(w)))
        for at in rng.sample(range(0, len(w), 5), round(len(w) * (0.004 + 0.0006 * i))):  # from about 0.96 down to 0.68
            w[at] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    alike = [len(a & b) / len(a | b) for a, b in ((shingle_set(rows[2 * i][1]), shingle_set(rows[2 * i + 1][1])) for i in range(60))]
    assert sum(0.80 <= x < 0.85 for x in alike) >= 5 and sum(x < 0.80 for x in alike) >= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, D).collect())
    assert kept == sorted(r[0] for r in brute(rows, 80) if r[3])


def test_near_duplicates_leave_a_small_plan(spark, capsys):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = P.drop_near_duplicates(spark, docs, D)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("Exchange") <= 12
    assert {f.rpartition("/wardline/")[2].rpartition("-")[0].partition("-")[0] for f in out.inputFiles() if "/wardline/" in f} == {"signatures", "groups"}
