import random

import numpy as np

from wardline.llm import textbytes as T


def test_hashes_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(1)
    texts = [b" ".join(bytes(rng.choices(b"abcXYZ\xc3\xa9", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [b"", b"  ", b"one", b"w" * 500, b"\tA b\x0bc\x0cd\re\n"]
    alone = [T.word_hashes([t])[0].tolist() for t in texts]
    expected = [T._LETTER.shape, [len(t.split()) for t in texts]]
    assert [len(x) for x in alone] == expected[1]
    monkeypatch.setattr(T, "PIECE", 64)
    hashes, first = T.word_hashes(texts)
    assert [hashes[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == alone
    words = {}
    for t, hs in zip(texts, alone, strict=True):
        for w, h in zip(t.lower().split(), hs, strict=True):
            assert words.setdefault(w, h) == h
    assert len(set(words.values())) == len(words)


def test_prefix_hashes():
    words = T.Words([b"abcdefgh abcdxxxx ab"])
    four = words.hashes(4)
    assert four[0] == four[1] == T.word_hashes([b"abcd"])[0][0] and four[2] == T.word_hashes([b"ab"])[0][0]


def test_shingles_are_sets():
    a, b, c, d = T.shingles([b"a b c d e f a b c d e", b"A\tb C d  e", b"a b", b""])
    assert len(a) == 6 and np.isin(b, a).all() and len(b) == 1 and len(c) == 1 and len(d) == 0
