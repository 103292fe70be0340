"""Alignment of two tokenizers' tokens over the same bytes, by products of incidence matrices.

Both tokenizers cut the bytes of a space and the text into tokens. Token-byte
incidence matrices A and B are held as compressed sparse rows; the row products of
A and the transposed B (each row of A gathers the rows of B's transpose that its bytes name, and equal columns
are added) give the overlap links. Where a row's first overlap lies behind the last overlap of the row
before, both tokenizers end a token, and a group ends. The products of the matrices
that tell how often an id occurs in each group then give the links: all pairs of an A and a B token of
one group, as id pairs with their number, so a group of very many tokens costs its different ids.

The number of documents that hold an id pair linked is counted over the corpus and stored with
a mark for the highest of each A id, in shards by A id. Documents look their pairs up there: in place where all shards
fit into a Python worker (`RESIDENT` bytes), else the pairs are sent to the tasks of their shards.

Defined results: texts that are null or empty, or whose tokens do not join to
the bytes of the space and the text in both tokenizers, have no tokens. Repeated rows and rows
that share an id count as documents of their own. Columns other than the id and the text are left behind.
A text is worked off as a whole by one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.bpe import PATTERN, blocks, printable_bytes
from lakekeep.llm.common import broadcast, only, stored
from lakekeep.llm.shards import RESIDENT, Shards, store_shards

#: Fixed value: the mark for a space in the pieces.
PIECE_SPACE = "▁"
#: A word with the spaces before it.
WORDS = re.compile(" +[^ ]*")
#: Beyond so many words whose pieces a Python worker knows, those not met again are forgotten; the longest word that is kept.
REMEMBERED, LONG_WORD = 300_000, 64
#: Code points of text that are worked off together, and entries that a product holds at once.
BLOCK, EXPANDED = 1_000_000, 4_000_000
#: Different id pairs that a task counts before it hands them on.
COUNTED = 2_000_000
#: Pairs of one shard, about.
SHARD_PAIRS = 1 << 20


class ByteLevel:
    """The byte-level tokenizer of a tokenizers file, without special tokens; None for texts whose bytes it does not keep.

    Where the file's merges make ids in ascending order, ids are ranks and the faster
    library gives the same tokens; else the file's own library is used.
    """

    def __init__(self, content: bytes):
        data, to_byte = json.loads(content), printable_bytes()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        raw = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in vocab.items()}
        raw |= {t["id"]: t["content"].encode() for t in data.get("added_tokens") or []}
        self.bytes_of = [raw.get(i, b"") for i in range(max(raw) + 1)]
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in merges]
        pre = data.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not data.get("normalizer")
        added = {t["content"] for t in data.get("added_tokens") or []}
        ranks = {raw[i]: i for t, i in vocab.items() if t not in added}
        in_order = all(a < b for a, b in zip(made, made[1:])) and sorted(len(raw[i]) for i in range(256)) == [1] * 256
        if plain and in_order and not data["model"].get("ignore_merges") and len(ranks) == 256 + len(made):
            fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            # Its tokens are the bytes of the text, whatever these are.
            self.encode = lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        else:
            own = tokenizers.Tokenizer.from_str(content.decode())
            own.no_truncation()
            own.no_padding()
            own.encode_special_tokens = True

            def encode(text: str) -> np.ndarray | None:
                ids = own.encode(text, add_special_tokens=False).ids
                same = b"".join(map(self.bytes_of.__getitem__, ids)) == text.encode()
                return np.array(ids, dtype=np.int64) if same else None

            self.encode = encode


class Pieces:
    """The tokenizer of a sentencepiece model, which puts the space before the text by itself.

    Where no piece holds a space behind anything but spaces, none reaches over
    the start of a word's spaces, so words with the spaces before them are encoded once and remembered.
    """

    def __init__(self, content: bytes):
        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [model.IdToPiece(i) for i in range(model.GetPieceSize())]
        self.bytes_of = [
            bytes([int(n[3:5], 16)]) if model.IsByte(i) else n.replace(PIECE_SPACE, " ").encode() for i, n in enumerate(names)
        ]
        self.apart = not any(PIECE_SPACE in n.lstrip(PIECE_SPACE) for n in names)
        self.blank = model.PieceToId(PIECE_SPACE)
        self.sizes = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words with the spaces before them into `known`; `odd` are those whose ids have other bytes."""
        self.known |= {w: self.before[w] for w in words if w in self.before}
        if " " in words:
            self.known[" "] = np.array([self.blank], dtype="<i4").tobytes()
        new = [w for w in words if w not in self.known]
        ids = self.model.encode([w[1:] for w in new], num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), dtype="<i4")
        ends = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        raw, at = flat.tobytes(), [0, *(4 * ends).tolist()]
        self.known.update(zip(new, [raw[s:e] for s, e in zip(at, at[1:])], strict=True))
        # All bytes at once, and the size of each word: then each word has its own bytes.
        wanted = [w.encode() for w in new]
        upto = np.concatenate([[0], np.cumsum(self.sizes[flat])])
        sizes = np.diff(upto[np.concatenate([[0], ends])])
        same = np.array_equal(sizes, np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted)))
        if not same or b"".join(map(self.bytes_of.__getitem__, flat.tolist())) != b"".join(wanted):
            self.odd |= {w for w, i, x in zip(new, ids, wanted, strict=True) if b"".join(map(self.bytes_of.__getitem__, i)) != x}

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, None where they do not have the bytes of a space and the text."""
        held = [WORDS.findall(" " + t) if self.apart else [" " + t] for t in texts]
        known = self.known
        self._learn({w for words in held for w in words if w not in known})
        out = [
            np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4").astype(np.int64) if self.odd.isdisjoint(words) else None
            for words in held
        ]
        if len(known) > REMEMBERED:
            self.before = {w: ids for w, ids in known.items() if len(w) <= LONG_WORD and w not in self.odd}
            self.known, self.odd = {}, set()
        return out


class Csr(NamedTuple):
    """A sparse matrix by rows: entries of row i lie at indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray


def row_products(left: Csr, right: Csr, width: int, most: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, sums) of left times right, row by row in ascending order.

    A row of the product is the sum of the rows of `right` that the entries of its row of `left`
    name. Runs of rows are worked off together, up to `most` entries before equal columns are added; `width` is the number of columns.
    """
    sizes = right.indptr[left.indices + 1] - right.indptr[left.indices]
    upto = np.concatenate([[0], np.cumsum(sizes)])[left.indptr]
    start, rows = 0, len(left.indptr) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
        first, last = left.indptr[start], left.indptr[end]
        n = sizes[first:last]
        shift = np.repeat(right.indptr[left.indices[first:last]] - (np.cumsum(n) - n), n)
        at = shift + np.arange(len(shift))
        row = np.repeat(np.arange(start, end), np.diff(left.indptr[start : end + 1]))
        key = np.repeat(row, n) * width + right.indices[at]
        value = right.data[at] * np.repeat(left.data[first:last], n)
        if len(key):
            if (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            yield key[heads] // width, key[heads] % width, np.add.reduceat(value, heads)
        start = end


def _joined(parts: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    held = list(parts)
    return tuple(np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3


def _pointers(keys: np.ndarray, n: int) -> np.ndarray:
    """Row pointers of entries that are sorted by their row."""
    return np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, shared bytes) of tokens over the same bytes."""
    total = int(size_a.sum())
    ones = np.ones(total, dtype=np.int64)
    a = Csr(np.concatenate([[0], np.cumsum(size_a)]), np.arange(total), ones)
    b_transposed = Csr(np.arange(total + 1), np.repeat(np.arange(len(size_b)), size_b), ones)
    return _joined(row_products(a, b_transposed, max(1, len(size_b))))


class Aligned(NamedTuple):
    """Several documents: a row for each token and each linked id pair."""

    group_a: np.ndarray
    group_b: np.ndarray
    pair_doc: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray
    links: np.ndarray
    overlap_doc: np.ndarray


def align(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, doc_a: np.ndarray, width_a: int, width_b: int) -> Aligned:
    """Groups and links of documents whose tokens are written one after the other; `doc_a` is the document of each A token.

    Both tokenizers end a token where a document ends, so no group crosses documents.
    """
    over_a, over_b, _ = overlaps(size_a, size_b)
    # The first and the last overlap of each A token; groups end where neither tokenizer's token goes on.
    first = over_b[np.flatnonzero(np.diff(over_a, prepend=-1))]
    last = over_b[np.flatnonzero(np.diff(over_a, append=-1))]
    group_a = np.cumsum(np.concatenate([[0], (first[1:] > last[:-1]).astype(np.int64)]))[: len(ids_a)]
    group_b = np.zeros(len(ids_b), dtype=np.int64)
    group_b[over_b] = group_a[over_a]
    groups = int(group_a[-1]) + 1 if len(group_a) else 0

    # How often each A id of a document (a row) is in each group, and each group (a row) holds each B id.
    row_ids, row = np.unique(doc_a * width_a + ids_a, return_inverse=True)
    cells, times = np.unique(row * max(1, groups) + group_a, return_counts=True)
    left = Csr(_pointers(cells // max(1, groups), len(row_ids)), cells % max(1, groups), times)
    cells, times = np.unique(group_b * width_b + ids_b, return_counts=True)
    right = Csr(_pointers(cells // width_b, groups), cells % width_b, times)
    rows, pair_b, links = _joined(row_products(left, right, width_b))
    return Aligned(group_a, group_b, row_ids[rows] // width_a, row_ids[rows] % width_a, pair_b, links, doc_a[over_a])


def _group_texts(ids_a, ids_b, group_a, group_b, ends: np.ndarray, table: list[bytes], width_a: int, width_b: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document; `ends` are the numbers of tokens up to each document's end."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    closes_a = np.diff(group_a, append=-1) != 0
    closes_b = np.diff(group_b, append=-1) != 0
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    codes[np.arange(len(ids_a)) + _pointers(group_b, groups)[group_a]] = ids_a + width_a * closes_a
    codes[np.arange(len(ids_b)) + _pointers(group_a, groups)[group_b + 1]] = 2 * width_a + ids_b + width_b * closes_b
    starts = [0, *ends.tolist()]
    return [b"".join(map(table.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip(starts, starts[1:])]


class Aligner:
    """Both tokenizers in one Python worker."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.width_a, self.width_b = len(self.a.bytes_of), len(self.b.bytes_of)
        self.size_a = np.array([len(t) for t in self.a.bytes_of], dtype=np.int64)
        self.size_b = self.b.sizes
        self.table = [
            b"%d%s" % (i, mark) for n, marks in ((self.width_a, (b",", b"|")), (self.width_b, (b",", b";"))) for mark in marks for i in range(n)
        ]

    def rows(self, texts: list[str | None], shift: int, wide: bool) -> list[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, keys, links, bytes of a link count)."""
        full = [k for k, t in enumerate(texts) if t]
        held = dict(zip(full, zip((self.a.encode(" " + texts[k]) for k in full), self.b.encode_all([texts[k] for k in full])), strict=True))
        docs = [k for k in full if held[k][0] is not None and held[k][1] is not None]
        none = (0, 0, 0, 0, 0, "", b"", b"", 1)
        out = [none] * len(texts)
        if not docs:
            return out
        a, b = (np.concatenate([held[k][side] for k in docs]) for side in (0, 1))
        n_a, n_b = (np.array([len(held[k][side]) for k in docs]) for side in (0, 1))
        doc_a = np.repeat(np.arange(len(docs)), n_a)
        found = align(a, b, self.size_a[a], self.size_b[b], doc_a, self.width_a, self.width_b)
        strings = _group_texts(a, b, found.group_a, found.group_b, np.cumsum(n_a + n_b), self.table, self.width_a, self.width_b)
        last = found.group_a[np.cumsum(n_a) - 1]
        n_groups = np.diff(last, prepend=-1)
        n_overlaps = np.bincount(found.overlap_doc, minlength=len(docs))
        at = _pointers(found.pair_doc, len(docs))
        keys = ((found.pair_a << shift) | found.pair_b).astype("<u8" if wide else "<u4")
        for d, k in enumerate(docs):
            own = slice(at[d], at[d + 1])
            links = found.links[own]
            width = np.min_scalar_type(int(links.max())).itemsize
            out[k] = (
                int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(links.sum()), int(n_overlaps[d]),
                hashlib.sha256(strings[d]).hexdigest(), keys[own].tobytes(), links.astype(f"<u{width}").tobytes(), width,
            )
        return out


_aligners: dict[tuple[int, int], Aligner] = {}


def aligner_of(byte_level: Broadcast, pieces: Broadcast) -> Aligner:
    """The aligner of this Python worker, built once from the files' bytes."""
    key = hash(byte_level.value), hash(pieces.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(byte_level.value, pieces.value)
    return _aligners[key]


ROW = pa.schema([
    ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")], ("groups_sha256", pa.string()),
    ("keys", pa.binary()), ("links", pa.binary()), ("width", pa.int32()),
])
ROW_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, keys binary, links binary, width int"
)


def aligned_rows(docs: DataFrame, byte_level: Broadcast, pieces: Broadcast, shift: int, wide: bool) -> DataFrame:
    """Every document's figures and its linked id pairs, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner_of(byte_level, pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks([t or "" for t in texts], BLOCK):
                rows = both.rows(texts[start:end], shift, wide)
                ids = batch.column(0).slice(start, end - start)
                arrays = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(ROW)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], schema=ROW)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ROW_DDL)


def pair_counts(rows: DataFrame, wide: bool) -> DataFrame:
    """(pair, n): the number of documents that hold an id pair linked; folded in the tasks first."""
    dtype = "<u8" if wide else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            found, at = np.unique(keys, return_inverse=True)
            return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)

        for batch in batches:
            keys, n = np.unique(np.frombuffer(b"".join(k for k in batch.column(0).to_pylist() if k), dtype), return_counts=True)
            held.append((keys, n.astype(np.int64)))
            size += len(keys)
            if size >= COUNTED:
                held = [folded()]
                size = len(held[0][0])
                if size >= COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held[0]], names=["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in folded()], names=["pair", "n"])

    return rows.select("keys").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class PairCounts:
    """The id pairs of one shard: sorted, with their counts and whether these are their A id's highest."""

    def __init__(self, row: dict):
        self.pairs = np.frombuffer(row["pairs"], "<i8")
        self.counts = np.frombuffer(row["counts"], row["width"])
        self.best = np.frombuffer(row["best"], np.bool_)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pairs, keys)
        return self.counts[at].astype(np.int64), self.best[at]


def store_counts(counts: DataFrame, shift: int, shard_pairs: int) -> tuple[str, int, int]:
    """The counts in shards by A id; their place, bytes and number."""
    counts = stored(counts, "pair-counts")
    count = max(1, -(-counts.count() // shard_pairs))
    a = F.shiftrightunsigned("pair", shift)
    dealt = counts.withColumn("shard", F.pmod(a, F.lit(count)).cast("int"))
    schema = pa.schema([("shard", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("width", pa.string()), ("best", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        pairs, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        heads = np.flatnonzero(np.diff(pairs >> shift, prepend=-1))
        top = np.repeat(np.maximum.reduceat(n, heads), np.diff(heads, append=len(pairs)))
        width = np.min_scalar_type(int(n.max())).newbyteorder("<")
        row = {
            "shard": table.column("shard")[0].as_py(), "pairs": pairs.astype("<i8").tobytes(), "counts": n.astype(width).tobytes(),
            "width": width.str, "best": (n == top).tobytes(),
        }
        return pa.Table.from_pylist([row], schema=schema)

    ddl = "shard int, pairs binary, counts binary, width string, best binary"
    path, size = store_shards(dealt.groupBy("shard").applyInArrow(build, ddl), "pair-shards")
    return path, size, count


def _sums(shards: Shards, count: int, shift: int, keys: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """n_best and count_sum of each row of pairs."""
    sizes = np.array([len(k) for k in keys])
    ends = np.cumsum(sizes)
    every = np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64)
    times = np.concatenate([*[x.astype(np.int64) for x in links], np.zeros(0, np.int64)])
    n, best = np.zeros(len(every), dtype=np.int64), np.zeros(len(every), dtype=bool)
    shard = (every >> shift) % count
    for s in np.unique(shard).tolist():
        own = np.flatnonzero(shard == s)
        n[own], best[own] = shards.get(s).look_up(every[own])
    zero = np.zeros(1, np.int64)
    upto_best, upto_sum = (np.concatenate([zero, np.cumsum(x)]) for x in (times * best, times * n))
    return upto_best[ends] - upto_best[ends - sizes], upto_sum[ends] - upto_sum[ends - sizes]


def _unpacked(batch: pa.RecordBatch, dtype: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [np.frombuffer(k, dtype) for k in batch.column("keys").to_pylist()]
    widths = batch.column("width").to_pylist()
    return keys, [np.frombuffer(x, f"<u{w}") for x, w in zip(batch.column("links").to_pylist(), widths, strict=True)]


def _in_place(rows: DataFrame, path: str, count: int, shift: int, wide: bool, resident: int) -> DataFrame:
    own = [c for c in rows.columns if c not in ("keys", "links", "width", "row")]
    dtype = "<u8" if wide else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path, PairCounts, resident)
        for batch in batches:
            best, total = _sums(shards, count, shift, *_unpacked(batch, dtype))
            arrays = [batch.column(c) for c in own] + [pa.array(best), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "n_best", "count_sum"])

    schema = rows.select(*own).schema.add("n_best", "long").add("count_sum", "long")
    return rows.select(*own, "keys", "links", "width").mapInArrow(run, schema)


def _by_shard(rows: DataFrame, path: str, count: int, shift: int, wide: bool, resident: int) -> DataFrame:
    """As `_in_place`, with each document's pairs sent to the tasks of their shards; a shard's are spread over several tasks."""
    dtype = "<u8" if wide else "<u4"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "shard", "keys", "links", "width"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            out = []
            for row, keys, links in zip(batch.column("row").to_pylist(), *_unpacked(batch, dtype), strict=True):
                shard = (keys >> shift) % count
                out += [(row, s, keys[shard == s].tobytes(), links[shard == s].tobytes(), links.itemsize) for s in np.unique(shard).tolist()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path, PairCounts, resident)
        for batch in batches:
            best, total = _sums(shards, count, shift, *_unpacked(batch, dtype))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"])

    sent = rows.select("row", "keys", "links", "width").mapInArrow(cut, "row long, shard int, keys binary, links binary, width int")
    dealt = sent.withColumn("salt", F.pmod(F.hash("row"), F.lit(64))).repartition("shard", "salt").sortWithinPartitions("shard").drop("salt", "shard")
    sums = dealt.mapInArrow(answer, "row long, n_best long, count_sum long").groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    told = rows.drop("keys", "links", "width").join(sums, "row", "left").drop("row")
    return told.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align_tokenizers(
    docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text",
    shard_pairs: int = SHARD_PAIRS, resident: int = RESIDENT,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum) of every document.

    `byte_level` and `pieces` name the files of the two tokenizers, read by the driver and broadcast: their
    size is that of vocabularies. Texts are tokenized once; each row's pairs are stored, counted, and looked up.
    """
    contents = []
    for name in (byte_level, pieces):
        with open(name, "rb") as f:
            contents.append(f.read())
    width_a, width_b = len(ByteLevel(contents[0]).bytes_of), len(Pieces(contents[1]).bytes_of)
    shift = max(1, (width_b - 1).bit_length())
    wide = (width_a - 1).bit_length() + shift > 32
    docs = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = aligned_rows(docs, *map(broadcast, contents), shift, wide).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "aligned")
    path, size, count = store_counts(pair_counts(rows, wide), shift, shard_pairs)
    look = _in_place if size <= resident else _by_shard
    return look(rows, path, count, shift, wide, resident)
