import re
import zlib

import numpy as np

from wardline.llm.terms import Terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["The  Quick-brown fox", "", "Straße ÉCOLE 42x", "a", "_under_score", "日本語 テスト\x00nul", "z" * 500 + " " + "y" * 64 + " " + "x" * 65, "\n\t ", "tail "]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def test_terms_runs_and_crc():
    terms = Terms([t.encode() for t in TEXTS])
    own = [PATTERN.findall(lower(t)) for t in TEXTS]
    for width, (spans, text) in enumerate(terms.runs(3), 1):
        want = [(i, " ".join(w[k : k + width])) for i, w in enumerate(own) for k in range(len(w) - width + 1)]
        got = [(int(i), spans.data[a:b].tobytes().decode()) for i, a, b in zip(text, spans.starts, spans.ends, strict=True)]
        assert got == want
        assert spans.crc32().tolist() == [zlib.crc32(w.encode()) for _, w in want]


def test_hashes_tell_terms_apart():
    words = [f"w{i}" for i in range(3000)] + ["q" * k for k in range(1, 130)]
    h = Terms([" ".join(words).encode(), " ".join(words[::-1]).encode()]).hashes()
    assert len(np.unique(h)) == len(words) and sorted(h[: len(words)].tolist()) == sorted(h[len(words) :].tolist())


def test_nothing():
    terms = Terms([b"", b"..."])
    assert terms.crc32().size == 0 and terms.hashes().size == 0 and [len(s.starts) for s, _ in terms.runs(2)] == [0, 0]
