"""Byte-level BPE encoding and decoding with a contiguous array of part boundaries and ranks.

Text is cut into pre-tokens by the pattern of the tokenizer. The parts of a
pre-token start as its bytes and lie in one contiguous row together with the
ranks of adjacent pairs; the lowest rank is searched for by scanning the row,
one boundary is deleted, and the two neighbouring ranks are refreshed. Rows of
many short pre-tokens are worked off together as a matrix. A pre-token longer
than `SHORT` bytes takes a heap over linked parts, where scanning would be
quadratic; both give the same ids.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to an empty text. The strings of added tokens are recognised in the
text, as the tokenizers library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from lakekeep.llm.common import broadcast

#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts below this code point are cut by the standard library's engine, which is faster.
LATIN = 0x250
#: Up to so many bytes a pre-token is worked off by scanning.
SHORT = 64
#: Beyond so many pre-tokens whose ids a Python worker knows, those not met again are forgotten.
CACHED = 120_000
#: Pre-tokens of one text that are held at once.
HELD = 200_000
NONE = np.iinfo(np.int32).max


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, for the code points from 256.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def latin_pattern() -> re.Pattern:
    """PATTERN for texts below LATIN: the same alternatives with the classes written out."""

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(kind, chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Tokenizer:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model, to_byte = data["model"], printable_bytes()
        self.bytes_of: dict[int, bytes] = {}
        ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            raw = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
            self.bytes_of[i] = raw
            ids[raw] = i
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a = bytes(to_byte[c] for c in left)
            b = bytes(to_byte[c] for c in right)
            self.rank.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self._hash_table()
        self.pattern, self.latin = regex.compile(PATTERN), latin_pattern()
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.by_id = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def _hash_table(self) -> None:
        """Pairs by open addressing, so that ranks of whole columns are looked up at once."""
        bits = max(4, (len(self.rank) * 4).bit_length())
        self._shift, size = np.uint64(64 - bits), 1 << bits
        self._mask = size - 1
        self._keys = np.full(size, -1, dtype=np.int64)
        self._ranks = np.full(size, NONE, dtype=np.int32)
        self._merged = np.zeros(size, dtype=np.int32)
        for (a, b), (rank, merged) in self.rank.items():
            key = (a << 32) | b
            at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self._keys[at] >= 0:
                at = (at + 1) & self._mask
            self._keys[at], self._ranks[at], self._merged[at] = key, rank, merged

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs in the hash table; a slot that is empty has no rank."""
        key = (a.astype(np.int64) << 32) | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)
        open_ = np.flatnonzero((self._keys[at] != key) & (self._keys[at] >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & self._mask
            there = self._keys[at[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return at

    def _scan_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of short pre-tokens, one row of parts and ranks for each."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        inside = np.arange(width) < lengths[:, None]
        parts = np.zeros((n, width), dtype=np.int32)
        parts[inside] = self.byte_ids[flat]
        ranks = np.full((n, width), NONE, dtype=np.int32)
        pairs = inside[:, 1:]
        ranks[:, :-1][pairs] = self._ranks[self._find(parts[:, :-1][pairs], parts[:, 1:][pairs])]
        out: list[bytes] = [b""] * n
        rows, left = np.arange(n), lengths.copy()
        columns = np.arange(width - 1)
        while rows.size:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = parts[r, : left[r]].astype("<u4").tobytes()
                keep = ~done
                rows, left, parts, ranks, at = rows[keep], left[keep], parts[keep], ranks[keep], at[keep]
                if not rows.size:
                    break
            k = np.arange(len(rows))
            parts[k, at] = self._merged[self._find(parts[k, at], parts[k, at + 1])]
            # Delete the boundary after `at`: what lies behind moves up by one.
            moved = columns > at[:, None]
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=moved)
            moved = columns >= at[:, None]
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=moved)
            ranks[:, -1] = NONE
            left -= 1
            follows = np.flatnonzero(at + 1 < left)
            ranks[k, at] = NONE
            f = at[follows]
            ranks[follows, f] = self._ranks[self._find(parts[follows, f], parts[follows, f + 1])]
            before = np.flatnonzero(at > 0)
            p = at[before]
            ranks[before, p - 1] = self._ranks[self._find(parts[before, p - 1], parts[before, p])]
        return out

    def _heap(self, word: bytes) -> bytes:
        """Ids of one long pre-token: pairs in a heap by rank and place, parts linked."""
        parts = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.rank.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (r[0], left, parts[left], parts[right]))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of pre-tokens into the cache."""
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "replace")
            width = next((w for w in (8, 16, 32, SHORT) if len(raw) <= w), 0)
            if width:
                own = by_width.setdefault(width, ([], []))
                own[0].append(word)
                own[1].append(raw)
            else:
                self.cache[word] = self._heap(raw)
        for width, (names, raws) in by_width.items():
            for start in range(0, len(raws), 16384):
                piece = slice(start, start + 16384)
                self.cache.update(zip(names[piece], self._scan_rows(raws[piece], width + 1), strict=True))

    def _words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, at most HELD at a time."""
        pattern = self.pattern if self.beyond.search(text) else self.latin
        if len(text) <= HELD:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while piece := list(islice(found, HELD)):
            yield piece

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """Pre-tokens, and the ids of added tokens between them."""
        if self.split_added is None:
            yield from self._words(text)
            return
        at = 0
        for m in self.split_added.finditer(text):
            yield from self._words(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self._words(text[at:] if at else text)

    def _known(self, words: set[str]) -> None:
        """Have the ids of pre-tokens in the cache: unknown ones are learned together, however full it is."""
        self.cache |= {w: self.before[w] for w in words if w in self.before}
        self.learn({w for w in words if w not in self.cache})

    def _forget(self) -> None:
        """When the cache is full, what it holds becomes the older half, and the older half before goes."""
        if len(self.cache) > CACHED:
            self.before, self.cache = self.cache, {}

    def _ids(self, part: list[str] | int) -> bytes:
        """Ids of pre-tokens that are in the cache, or of an added token."""
        if isinstance(part, int):
            return np.array([part], dtype="<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, part))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a long text is worked off in pieces."""
        out = []
        for part in self._parts(text):
            if not isinstance(part, int):
                self._known({w for w in part if w not in self.cache})
            out.append(self._ids(part))
            self._forget()
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As `encode`; the unknown pre-tokens of short texts are worked off together."""
        held = [list(self._parts(t)) if len(t) <= HELD else None for t in texts]
        cache = self.cache
        self._known({w for parts in held if parts for part in parts if not isinstance(part, int) for w in part if w not in cache})
        short = [None if parts is None else b"".join(map(self._ids, parts)) for parts in held]
        self._forget()
        return [self.encode(t) if ids is None else ids for t, ids in zip(texts, short, strict=True)]

    def decode(self, ids: bytes) -> str:
        found = map(self.by_id.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(found).decode("utf-8", "replace")


_tokenizers: dict[int, Tokenizer] = {}


def tokenizer_of(content: Broadcast) -> Tokenizer:
    """The tokenizer of this Python worker; it is built once from the file's bytes."""
    key = hash(content.value)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(content.value)
    return _tokenizers[key]


def blocks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters together, one text at least."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`df` with `ids` (binary, little-endian unsigned 32-bit) and `decoded` in place of its text.

    `path` names the tokenizer file, read by the driver and broadcast: its
    size is that of a vocabulary, whatever the data.
    """
    with open(path, "rb") as f:
        content = broadcast(f.read())
    others = [c for c in df.columns if c != text]
    schema = df.select(*others).schema.add("ids", "binary").add("decoded", "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(content)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            for start, end in blocks(texts):
                own = texts[start:end]
                ids = tokenizer.encode_all(own)
                decoded = [tokenizer.decode(i) for i in ids]
                kept = [batch.column(k).slice(start, end - start) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=schema.names
                )
            pa.default_memory_pool().release_unused()

    return df.select(*others, text).mapInArrow(run, schema)
