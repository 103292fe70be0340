"""Line dedup by a sharded minimal perfect hash over line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys
found in several documents are folded by their 128-bit hash and dealt to
shards. Each shard builds a minimal perfect hash: on every level the keys that
are alone at their place of a bit row settle there, the others go on to the next level, and
the number of set bits before a key's own is its slot. At the slots lie three arrays: a
64-bit fingerprint, which turns away keys that were never indexed, the number of documents,
and the document that keeps the line. Documents probe these arrays; lines are
not joined.

The arrays are stored once in the shared folder. Where all of them fit into a
Python worker (`RESIDENT` bytes), every task probes them in place. Beyond, the hashes of a document's lines are sent to
the tasks of their shards, which hold a few shards at a time, and what was found comes back; both ways give the same rows.

Defined results: a document is a row; repeated rows count each. Documents
without an id count as below all others. All rows of the largest id that holds a line keep
it, wherever it stands. A null text counts as one empty line. Columns other than the id and
the text are left behind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.common import only, ship, stored
from lakekeep.llm.shards import RESIDENT, Shards, store_shards

#: The shortest key in code points, and the least number of documents, that make a line repeated.
MIN_CHARS, MIN_DOCS = 20, 3
#: Fixed value: the white space taken off both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
#: Keys of one shard, about.
SHARD_KEYS = 1 << 17
#: Bits of a level for each key that is left.
SPARSE = 1.5
#: Bytes of text that are worked off together.
BLOCK = 4_000_000
NOBODY = np.iinfo(np.int64).min


def key_of(line: bytes) -> bytes | None:
    """The key of a line, None where it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return key


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two signed 64-bit halves of 128-bit hashes."""
    flat = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves for one level."""
    x = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n-1 for n different keys; a key that is none of them gets any slot, or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, rows = [], []
        high, low = high.copy(), low.copy()
        while high.size:
            size = -(-int(SPARSE * high.size + 1) // 64) * 64
            at = _mixed(high, low, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            rows.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at.astype(np.int64)]
            high, low = high[left], low[left]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(rows) if rows else np.zeros(0, dtype="<u8"))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, size in enumerate(self.sizes.tolist()):
            if not left.size:
                break
            at = _mixed(high[left], low[left], level) % np.uint64(size)
            word = self.starts[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (at & np.uint64(63))
            held = self.words[word]
            here = (held & bit) != 0
            out[left[here]] = self.before[word[here]] + np.bitwise_count(held[here] & (bit[here] - np.uint64(1)))
            left = left[~here]
        return out


class LineIndex:
    """One shard: a perfect hash, and at its slots fingerprints, numbers of documents and keepers."""

    def __init__(self, hashed: PerfectHash, marks: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hashed, self.marks, self.counts, self.keepers = hashed, marks, counts, keepers

    @classmethod
    def parse(cls, row: dict) -> LineIndex:
        hashed = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["words"], "<u8"))
        counts = np.frombuffer(row["counts"], row["width"])
        return cls(hashed, np.frombuffer(row["marks"], "<i8"), counts, np.frombuffer(row["keepers"], "<i8"))

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the keys that were indexed, and their counts and keepers."""
        slots = self.hashed.slots(high, low)
        hit = np.flatnonzero(slots >= 0)
        hit = hit[self.marks[slots[hit]] == low[hit]]
        return hit, self.counts[slots[hit]].astype(np.int64), self.keepers[slots[hit]]


SHARD_SCHEMA = "shard int, sizes binary, words binary, marks binary, counts binary, width string, keepers binary"


def build_shard(table: pa.Table) -> pa.Table:
    """The arrays of one shard from its rows (shard, high, low, n, keeper)."""
    high, low, n, keeper = (table.column(c).to_numpy() for c in ("high", "low", "n", "keeper"))
    hashed = PerfectHash.of(high, low)
    order = np.empty(len(high), dtype=np.int64)
    order[hashed.slots(high, low)] = np.arange(len(high))
    width = np.min_scalar_type(int(n.max())).newbyteorder("<")
    row = {
        "shard": table.column("shard")[0].as_py(), "sizes": hashed.sizes.astype("<i8").tobytes(), "words": hashed.words.tobytes(),
        "marks": low[order].tobytes(), "counts": n[order].astype(width).tobytes(), "width": width.str, "keepers": keeper[order].tobytes(),
    }
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *[
        (c, pa.string() if c == "width" else pa.binary()) for c in ("sizes", "words", "marks", "counts", "width", "keepers")
    ]]))


def _blocks(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with about BLOCK bytes of text, and the lines of each text."""
    for batch in batches:
        column = batch.column(text)
        texts = column.cast(pa.large_binary())
        start = size = 0
        lengths = [0 if v is None else v for v in pc.binary_length(texts).to_pylist()]
        for k, length in enumerate(lengths):
            size += length
            if size >= BLOCK or k == len(lengths) - 1:
                piece = slice(start, k + 1)
                yield batch.slice(start, k + 1 - start), [(t or b"").split(b"\n") for t in texts[piece].to_pylist()]
                start, size = k + 1, 0


def line_keys(docs: DataFrame) -> DataFrame:
    """(high, low, doc_id): every different key of every document, as the halves of its hash."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches):
            found: list[bytes] = []
            sizes = []
            for lines in texts:
                own = {key for line in lines if (key := key_of(line)) is not None}
                found += map(digest, own)
                sizes.append(len(own))
            high, low = halves(found)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), ids], schema=schema)

    ship()
    return docs.mapInArrow(run, "high long, low long, doc_id long")


def index_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """Build and store the shards over the keys of `docs` (doc_id, text) found in at least `min_docs` rows.

    Returns their place, the bytes of all arrays, and the number of shards, which grows with that of such keys.
    """
    keeper = F.max(F.coalesce("doc_id", F.lit(int(NOBODY)))).alias("keeper")
    held = line_keys(docs).groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), keeper)
    held = stored(held.where(F.col("n") >= min_docs), "line-counts")
    count = max(1, -(-held.count() // shard_keys))
    dealt = held.withColumn("shard", F.pmod("high", F.lit(count)).cast("int"))
    path, size = store_shards(dealt.groupBy("shard").applyInArrow(build_shard, SHARD_SCHEMA), "line-shards")
    return path, size, count


def _looked_up(shards: Shards, count: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key its number of documents (0: not indexed) and its keeper."""
    n, keeper = np.zeros(len(high), dtype=np.int64), np.full(len(high), NOBODY, dtype=np.int64)
    shard = high % count
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.diff(shard[order], append=-1)) + 1
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        own = order[start:end]
        index = shards.get(int(shard[own[0]]))
        if index is not None:
            hit, counts, keepers = index.probe(high[own], low[own])
            n[own[hit]], keeper[own[hit]] = counts, keepers
    return n, keeper


def _told(lines: list[bytes], doomed: dict[bytes, int]) -> tuple[bytes, int, int, int]:
    """The kept text, the numbers of lines and of dropped lines, and the most documents a dropped line is in."""
    kept, most = [], 0
    for line in lines:
        key = key_of(line)
        n = 0 if key is None else doomed.get(key, 0)
        if n:
            most = max(most, n)
        else:
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept), most


OUT = "doc_id long, kept string, n_lines long, n_dropped long, most_docs long"


def _batch(ids: pa.Array, told: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    kept, *numbers = zip(*told, strict=True)
    arrays = [ids, pa.array(kept, pa.binary()).cast(pa.string()), *[pa.array(x, pa.int64()) for x in numbers]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kept", "n_lines", "n_dropped", "most_docs"])


def _probed_in_place(docs: DataFrame, path: str, count: int, resident: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path, LineIndex.parse, resident)
        for batch, texts in _blocks(batches):
            keys = [list({key for line in lines if (key := key_of(line)) is not None}) for lines in texts]
            own = np.repeat([NOBODY if i is None else i for i in batch.column(0).to_pylist()], [len(k) for k in keys])
            n, keeper = _looked_up(shards, count, *halves([digest(k) for ks in keys for k in ks]))
            n[keeper == own] = 0
            told, at = [], 0
            for lines, ks in zip(texts, keys, strict=True):
                told.append(_told(lines, dict(zip(ks, n[at : at + len(ks)].tolist(), strict=True))))
                at += len(ks)
            yield _batch(batch.column(0), told)

    return docs.mapInArrow(run, OUT)


def _probed_by_shard(docs: DataFrame, path: str, count: int, resident: int) -> DataFrame:
    """As `_probed_in_place`, with the hashes sent to the tasks of their shards.

    What becomes of a row depends on its id and text alone, so these name the row: there is
    nothing to number. A shard's hashes are spread over several tasks.
    """
    named = docs.withColumn("name", F.md5(F.coalesce("text", F.lit(""))))
    asked_schema = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("shard", pa.int32()), ("keys", pa.binary())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches):
            rows = []
            for i, name, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                by_shard: dict[int, list[bytes]] = {}
                for key in {k for line in lines if (k := key_of(line)) is not None}:
                    d = digest(key)
                    by_shard.setdefault(int.from_bytes(d[:8], "little", signed=True) % count, []).append(d)
                rows += [{"doc_id": i, "name": name, "shard": s, "keys": b"".join(ds)} for s, ds in by_shard.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=asked_schema)

    found_schema = pa.schema([("doc_id", pa.int64()), ("name", pa.string()), ("keys", pa.binary()), ("n", pa.binary())])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path, LineIndex.parse, resident)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, keeper = _looked_up(shards, count, *halves([r["keys"]]))
                gone = np.flatnonzero((n > 0) & (keeper != (NOBODY if r["doc_id"] is None else r["doc_id"])))
                if gone.size:
                    keys = np.frombuffer(r["keys"], "<i8").reshape(-1, 2)
                    rows.append({"doc_id": r["doc_id"], "name": r["name"], "keys": keys[gone].tobytes(), "n": n[gone].astype("<i8").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=found_schema)

    asked = named.mapInArrow(ask, "doc_id long, name string, shard int, keys binary").withColumn("salt", F.pmod(F.hash("name"), F.lit(64)))
    dealt = asked.repartition("shard", "salt").sortWithinPartitions("shard").select("doc_id", "name", "shard", "keys")
    found = dealt.mapInArrow(answer, "doc_id long, name string, keys binary, n binary").distinct()
    # At most one entry for each shard: as many as the text has keys, or fewer.
    found = found.groupBy("doc_id", "name").agg(F.collect_list(F.struct("keys", "n")).alias("found"))
    found = found.select(F.col("doc_id").alias("_i"), F.col("name").alias("_n"), "found")
    joined = named.join(found, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("name") == F.col("_n")), "left")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches):
            told = []
            for lines, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                gone: dict[bytes, int] = {}
                for entry in found or []:
                    marks = [entry["keys"][k : k + 16] for k in range(0, len(entry["keys"]), 16)]
                    gone.update(zip(marks, np.frombuffer(entry["n"], "<i8").tolist(), strict=True))
                doomed = {k: gone.get(digest(k), 0) for line in lines if (k := key_of(line)) is not None} if gone else {}
                told.append(_told(lines, doomed))
            yield _batch(batch.column(0), told)

    return joined.select("doc_id", "text", "found").mapInArrow(drop, OUT)


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, resident: int = RESIDENT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped, most_docs): every row's text without the lines that a later document keeps.

    `most_docs` is the largest number of documents that one of the dropped lines is in.
    """
    docs = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path, size, count = index_lines(docs, min_docs, shard_keys)
    probed = _probed_in_place if size <= resident else _probed_by_shard
    return probed(docs, path, count, resident)
