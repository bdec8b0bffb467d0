import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm import cutting_stock as C
from wardline.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def laid_out(runs):
    """Every slot of a plan by sequence."""
    by = defaultdict(list)
    for n, a, b, fit, first, at in runs:
        for r in range(a, b):
            by[first + (r - a) // fit].append((at + (r - a) % fit * n, n))
    return by


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.choice([1, 2, 30, 500]) for n in rng.sample(range(1, 129), rng.randint(1, 60))}
    runs = C.plan(counts, 128)
    by_length = defaultdict(list)
    for n, a, b, *_ in runs:
        by_length[n].append((a, b))
    for n, k in counts.items():
        own = sorted(by_length[n])
        assert own[0][0] == 0 and own[-1][1] == k and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    cost = total = 0
    for slots in laid_out(runs).values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 128
        cost, total = cost + C.padded(at, 128), total + at
    assert total == sum(n * k for n, k in counts.items()) and C.padding(runs, 128) == (cost - total, total)


def test_plan_reaches_a_known_optimum():
    # 100 sequences of 60 + 40 + 28 and 50 of 3 * 42 + 2, mixed up; longest first wastes room here
    counts = {60: 100, 40: 100, 28: 100, 42: 150, 2: 50}
    assert C.padding(C.plan(counts, 128), 128)[0] == 0
    # 45 and 35 twice fill 115, 45 twice leaves more: the program finds 45 + 48 + 35
    counts = {45: 90, 48: 90, 35: 90}
    assert C.padding(C.plan(counts, 128), 128)[0] == 0 < C.padding(packing.plan(counts, 128), 128)[0]


def test_no_better_by_columns_that_were_not_made():
    """The duals at the end price every pattern at its cost or under (small enough to enumerate)."""
    counts = {5: 40, 7: 33, 11: 21}
    program = C.Columns(counts, 32)
    program.solve()
    duals = program.costs @ program.inverse
    for a in range(7):
        for b in range(5):
            for c in range(3):
                total = 5 * a + 7 * b + 11 * c
                if 0 < total <= 32:
                    assert duals @ [a, b, c] <= program.cost_of[total] + 1e-3 or program.costs @ program.x <= sum(n * k for n, k in counts.items()) * (1 + C.SEQUENCE_COST / 32) * (1 + C.CLOSE)
    taken = sum(x * np.array([p.get(n, 0) for n in (5, 7, 11)]) for p, x in zip(program.basis, program.x, strict=True))
    assert np.allclose(taken, [40, 33, 21]) and (program.x >= -1e-9).all()


def test_longer_than_capacity_is_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        C.plan({129: 1}, 128)


def check(rows, docs, capacity):
    library = Tokenizer.from_file(BYTES)
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
        assert r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    cost = total = 0
    for slots in by_sequence.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= capacity
        cost, total = cost + C.padded(at, capacity), total + at
    expected, got = defaultdict(list), defaultdict(list)
    for i, t, *_ in docs:
        expected[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for i, own in by_document.items():
        copies = len(expected[i])
        own.sort(key=lambda r: (r.doc_tokens, r.start))
        got[i] = sorted(b"".join(bytes(r.ids) for r in own[c::copies] if True) for c in range(copies)) if copies > 1 else [b"".join(bytes(r.ids) for r in own)]
        assert all(r.doc_tokens in {len(x) // 4 for x in expected[i]} for r in own)
    for i, x in expected.items():
        if len(x) == 1:
            assert got[i] == x
    assert total == sum(len(x) // 4 for v in expected.values() for x in v)
    return (cost - total) / total


def test_pack_on_spark(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["the", "over", "Straße", "x1", "quick"], k=rng.randint(0, 90))), "x") for i in range(400)]
    docs += [(400, None, "a"), (401, "", "b"), (402, "long " * 4000, "c"), (None, "null id", "d"), (403, "twice", "e"), (403, "twice", "e")]
    d = spark.createDataFrame(docs, "doc_id long, text string, sequence_id string")
    rows = C.pack(d, BYTES, 256).collect()
    assert check(rows, docs, 256) < 0.02
    assert C.pack(d.limit(0), BYTES, 256).count() == 0
    small = C.pack(d, BYTES, 256, keep_ids=False)
    assert "ids" not in small.columns and small.count() == len(rows)


def test_equal_lengths_are_cut_to_fill(spark):
    """All of one length that does not divide the capacity: without cuts over two thirds more would be padding."""
    docs = [(i, "word " * 149) for i in range(700)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = C.pack(d, BYTES, 256).collect()
    assert {r.doc_tokens for r in rows} == {151}
    assert check(rows, docs, 256) < 0.03
    assert len(rows) < 2 * len(docs)
