"""Shared pieces of the operators that tokenize: rows in Arrow batches, bounded caches, byte-level ids."""

from __future__ import annotations

import ctypes
import json
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute

#: Entries a cache of chunks may hold before it starts anew; a worker process keeps it between tasks.
CACHE_ENTRIES = 300_000
#: Rows that are worked on at once inside an Arrow batch.
ROWS = 256
#: Of the C library, where it has it: freed memory goes back to the system.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Spark keeps workers between tasks, and what they hold counts with their executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, rows: int = ROWS, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows, cut earlier where texts are long; after the last one, freed memory is given back."""
    start = 0
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes = [a + (b or 0) for a, b in zip(sizes, pa.compute.binary_length(column).to_pylist(), strict=True)]
    while start < batch.num_rows:
        end, total = start, 0
        while end < batch.num_rows and end - start < rows and (end == start or total + sizes[end] <= most_bytes):
            total += sizes[end]
            end += 1
        yield batch.slice(start, end - start)
        start = end
    give_back()


class ChunkCache:
    """Results by chunk, in two generations: when the young one is full it becomes the old one, and only what is used again is taken over."""

    def __init__(self, learn: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.learn, self.entries = learn, entries
        self.young: dict = {}
        self.old: dict = {}

    def take(self, chunks: set[str]) -> dict:
        """A mapping that holds all of ``chunks``."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for c in chunks.difference(young):
            if (x := old.get(c)) is None:
                new.append(c)
            else:
                young[c] = x
        if new:
            young.update(zip(new, self.learn(new), strict=True))
        return young


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes themselves, the rest in order from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class ByteTokenizer:
    """Ids of a byte-level tokenizers file, as little-endian uint32 bytes.

    Where a file's ids rise in the order of its merges (checked here), tiktoken's merge loop over the
    same vocabulary gives the same ids several times faster. Texts that hold an added token's string,
    which the library cuts out first, and files of another kind go to the library.
    """

    #: How the library's byte-level step cuts a text into words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self._merge_loop(spec)

    @cached_property
    def library(self):
        """Read only when a text needs it: it holds as much memory again as the merge loop."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _merge_loop(self, spec: dict):
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(set(made)) or len(vocab) != len(made) + 256:
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes([byte[c] for c in t]): i for t, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.fast and not any(a in t for a in self.added):
                out.append(array("I", self.fast(t)).tobytes())
            else:
                out.append(array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes())
        return out


_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
        give_back()  # what the file's JSON took
    return _tokenizers[path]


def forget_tokenizers() -> None:
    """For tasks that tokenize nothing: what earlier tasks of the worker process have read of tokenizers' files goes."""
    if _tokenizers:
        _tokenizers.clear()
        give_back()
