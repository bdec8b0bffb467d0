"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

A word's encoding ends in a token t such that what stands before t is encoded as if it stood alone,
and the pair (last token before, t) is one that BPE itself would leave apart. So the last token of
every prefix determines all encodings. The distinct words of a batch are put into a trie (sorted
words, with a stack of the current path); a walk down the trie computes the last token of each new
node once and every word below shares it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .tokenizing import CACHE_ENTRIES, ChunkCache, byte_letters, slices

END = "</w>"
SHORT = (3, 2, 1)
#: Chunks of printable ASCII and the letters up to U+017F, in composed form, are cut by this pattern; all others by the library.
_plain = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")


class TrieBpe:
    """Encodes words of one vocabulary file. Caches hold, by word in byte letters and by chunk, ids as bytes and tokens joined by spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        #: The two parts of a token and the rank of their merge; the first merge that makes it is the one that counts.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.parts.setdefault(self.vocab[a + b], (self.vocab[a], self.vocab[b], r))
        self.made = {self.vocab[a + b] for a, b in pairs}
        #: Single symbols and merged tokens; others of the vocabulary are never produced.
        self.tokens = {t: i for t, i in self.vocab.items() if i in self.made or len(t.removesuffix(END)) == 1}
        #: Lengths, longest first, of the tokens that end in given four characters (inside a word, at its end); shorter ones are tried after them.
        self.lengths: tuple[dict, dict] = ({}, {})
        for t in self.tokens:
            body = t.removesuffix(END)
            if len(body) >= 4:
                self.lengths[t != body].setdefault(body[-4:], set()).add(len(body))
        for by in self.lengths:
            by.update({k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in by.items()})
        self.apart: dict[tuple[int, int], bool] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.chunks = ChunkCache(self.learn)
        self.words = ChunkCache(self.learn_words)

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE on the text of both leaves exactly this pair: no merge across the border comes before the merges that build the two."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 4 * CACHE_ENTRIES:
                self.apart.clear()
            known = self.apart[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        none = 1 << 60
        bound = none
        while True:
            if self.rank.get((left, right), none) < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Undo the later of the two merges. A merge at the border that ranks the same as one on its right
            # comes first (leftmost first); one that ranks the same as one on its left comes after it.
            if b is None or (a is not None and a[2] > b[2]):
                bound, left = a[2], a[1]
            else:
                bound, right = b[2] + 1, b[0]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word given in byte letters."""
        out: dict[str, list[int]] = {}
        tokens, apart, inside, at_end = self.tokens, self.stay_apart, *self.lengths
        known = self.apart
        last, back = [-1], [0]  # of the path: the last token of each prefix, and its length
        before = ""
        for word in sorted(words):
            same, n = 0, len(word)
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            same = min(same, n - 1, len(last) - 1)
            del last[same + 1 :], back[same + 1 :]
            for i in range(same + 1, n + 1):
                end = END if i == n else ""
                for k in (at_end if end else inside).get(word[i - 4 : i], SHORT) if i >= 4 else SHORT[3 - i :]:
                    if k > i:
                        continue
                    t = tokens.get(word[i - k : i] + end)
                    if t is None:
                        continue
                    if k == i:
                        # A whole prefix that is a token is its own encoding only if BPE arrives at it.
                        if k == 1 or self.whole(t):
                            break
                        continue
                    p = (last[i - k], t)
                    ok = known.get(p)
                    if apart(*p) if ok is None else ok:
                        break
                if i < n:
                    last.append(t)
                    back.append(k)
            ids, i = [t], n - k
            while i > 0:
                ids.append(last[i])
                i -= back[i]
            out[word] = ids[::-1]
            before = word
        return out

    def whole(self, t: int) -> bool:
        parts = self.parts.get(t)
        return parts is None or self.merges_to(t)

    def merges_to(self, t: int) -> bool:
        """Whether BPE on a token's own text gives the token."""
        key = (t, -1)
        if key not in self.apart:
            text = self.token[t]
            body = text.removesuffix(END)
            symbols = [*body[:-1], body[-1] + text[len(body) :]]
            ids = [self.vocab[s] for s in symbols]
            while len(ids) > 1:
                r, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
                if r == 1 << 60:
                    break
                pair, new, i = (ids[at], ids[at + 1]), [], 0
                made = self.vocab[self.token[pair[0]] + self.token[pair[1]]]
                while i < len(ids):
                    if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                        new.append(made)
                        i += 2
                    else:
                        new.append(ids[i])
                        i += 1
                ids = new
            self.apart[key] = ids == [t]
        return self.apart[key]

    def words_of(self, chunk: str) -> list[str]:
        """A chunk's words in byte letters; special tokens, which the library cuts out first, stay as they are."""
        if "<|" in chunk and self.special_re.search(chunk):
            return [w for p in self.special_re.split(chunk) for w in ([p] if p in self.special else self.words_of(p)) if w]
        if _plain.fullmatch(chunk):
            words = _words.findall(chunk.lower())
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [w for w, _ in self.split(self.normalize(chunk))]

    def learn_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        ids = self.encode_words([w for w in words if w not in self.special])
        token = self.token
        return [(array("I", [self.special[w]]).tobytes(), w) if w in self.special else (array("I", x := ids[w]).tobytes(), " ".join([token[i] for i in x])) for w in words]

    def learn(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Chunks that differ in punctuation share their words' encodings."""
        cut = [self.words_of(c) for c in chunks]
        known = self.words.take({w for ws in cut for w in ws})
        return [known[ws[0]] if len(ws) == 1 else (b"".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])) for ws in cut]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian uint32) and decoded text. White space only separates, so a text is cut at spaces and line breaks, and each distinct chunk is encoded once."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        distinct = set()
        for parts in cut:
            distinct.update(parts)
        chunks, ids, decoded = self.chunks.take(distinct), [], []
        for parts in cut:
            found = [chunks[c] for c in parts]
            ids.append(b"".join([x[0] for x in found]))
            decoded.append(" ".join([x[1] for x in found if x[1]]))
        return ids, decoded


_encoders: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = TrieBpe(path)
    return _encoders[path]


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``ids`` (its token ids as little-endian unsigned 32-bit integers) and ``decoded`` (its tokens joined as the library's decode does).

    ``tokenizer_path`` is a word-level BPE file (words end in ``</w>``) and must be readable on the executors.
    Null and empty texts have no ids and decode to the empty string. Rows are encoded each for
    itself, whatever their id (null and repeated ids pass through); other columns are not read.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                ids, decoded = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
