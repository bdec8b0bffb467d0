import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import packing, registry, tokenizing
from wardline.llm.tokenizing import ByteTokenizer
from wardline.llm.trie_bpe import TrieBpe, bpe_encode_decode

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \n\t  abcdefgXYZ'stre0123.,!?-<|>éßñœΣσ漢字😀́\x1c\x85\xa0²Ⅷ_İ"


def texts(n=1500):
    rng = random.Random(5)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", None, "<|endoftext|>a <|startoftext|>B<|endoftext|>", "don't I'LL we've'd", "  a  b ", "x\n\ny z  w", "word " * 3000, "q" * 5000]


def test_chunked_ids_equal_the_library():
    own, library = ByteTokenizer(BYTES), Tokenizer.from_file(BYTES)
    for t in texts():
        t = t or ""
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_trie_equals_the_library():
    own, library = TrieBpe(WORDS), Tokenizer.from_file(WORDS)
    for t in texts():
        t = t or ""
        ids, decoded = own.encode([t])
        expected = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids[0], "<u4").tolist() == expected, repr(t)
        assert decoded[0] == library.decode(expected, skip_special_tokens=False), repr(t)


def test_encode_decode_on_spark(spark):
    rows = [(i % 40, t, "x") for i, t in enumerate(texts(60))] + [(None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.ids), r.decoded) for r in bpe_encode_decode(df, WORDS).collect())
    library = Tokenizer.from_file(WORDS)
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i is None, i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    assert bpe_encode_decode(df.limit(0), WORDS).count() == 0


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_whole_documents(spark):
    rows = [(i % 50, t) for i, t in enumerate(texts(100))] + [(None, "a b"), (7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(df, BYTES, capacity=64).collect()
    library = Tokenizer.from_file(BYTES)
    expected = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        expected += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(expected)
    n = check_packed(packed, 64)
    assert n <= 1.02 * sum(r.length for r in packed) / 64 + 2
    whole = packing.sequences(spark.createDataFrame(packed)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed)
    assert packing.pack(df.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_and_complete(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(20)}
    runs = packing.plan(counts, 50)
    used, room = defaultdict(int), defaultdict(list)
    for length, a, b, fit, first, at in runs:
        used[length] += b - a
        for r in range(a, b):
            room[first + (r - a) // fit].append((at + (r - a) % fit * length, length))
    assert used == counts
    for slots in room.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 50
    assert len(room) <= 11 / 9 * -(-sum(k * v for k, v in counts.items()) // 50) + 1


def test_hot_length_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 100)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 20 + 1).cast("long").alias("length"))
    rows = packing.best_fit(df, 20).collect()
    assert len(rows) == 2000
    assert check_packed(rows, 20) <= sum(r.length for r in rows) / 20 * 1.05 + 1


def test_rejects_bad_lengths():
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 5)


def test_queries_have_the_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    assert registry.QUERIES["op1_best_fit_packing"](spark, d).columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert registry.QUERIES["op10_trie_bpe"](spark, d).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_tokenizers_are_forgotten_and_read_again():
    before = tokenizing.byte_tokenizer(BYTES).encode(["the end"])
    tokenizing.forget_tokenizers()
    assert not tokenizing._tokenizers
    assert tokenizing.byte_tokenizer(BYTES).encode(["the end"]) == before
