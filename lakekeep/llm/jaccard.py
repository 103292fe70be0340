"""Exact Jaccard join of sets of word 5-grams, with answers shared between similar sets.

Every text becomes the set of hashes of its 5-word shingles. Sets that are
equal are one set from then on. Each set puts a prefix of its tokens, rarest
first, into an index: with similarity t, two sets that reach it share a token
within the first n - ceil(t n) + 1 tokens of the larger and the first
n - ceil(2 t n / (1 + t)) + 1 of the smaller.

* Rare first: tokens that many prefixes hold are marked in a bit map of fixed
  size; a marked token sorts behind all others. Any order is right, as long as all
  sets use the same; a full map costs speed only.
* Skipping in the index: the entries of a token are kept in blocks of equal
  size, position and component. Two blocks are compared as wholes first, and
  left out together when sizes, positions or components say that they hold no new link.
* Skipping by answers: in each list every set is compared with the set that
  meets most others and with its neighbour, which is linear in the index. What that links
  is one component, within which no pair is looked at again. For the remaining pairs
  (x, y) the computed answer of (x, q) with q similar to y is used: Jaccard distance is
  a metric, so d(x, q) - d(q, y) above 1 - t rules the pair out.

Pairs that are left must share enough of their prefixes, and are then verified on the whole sets with integer arithmetic. Shingles
are compared by 64-bit hashes: for two texts of a thousand words the chance
that one pair of different shingles agrees is below 10^-13.

Defined results: a text with fewer than 5 words is one shingle; null, empty and
blank texts have none, link with nothing and keep their own doc_id. Rows
with equal sets share a component, rows with the same doc_id as well if their sets are linked.
Without a doc_id in a component its id is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lakekeep.llm.bpe import blocks
from lakekeep.llm.common import broadcast, only, ship, stored
from lakekeep.llm.components import components

WORDS, PERCENT = 5, 80
#: A token is frequent when more prefixes than this hold it.
FREQUENT = 32
#: Bits of the maps of frequent tokens and of sets in question: 2 MB each.
MAP_BITS = 24
#: Lists up to this length give pairs; longer ones are compared block by block, and give no pairs.
SHORT_LIST = 64
#: Sets and tokens in one block of a long list.
BLOCK_SETS, BLOCK_TOKENS = 2048, 1 << 19
#: Tokens of one product of incidence matrices, and sets of one strip of it.
PRODUCT_TOKENS, STRIP_SETS = 4096, 256
#: Entries of one list that are put in order together.
LIST_PART = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
_random = np.random.default_rng(20240501)
BYTE_KEYS = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_KEYS = _random.integers(1, 2**63, 1 << 14, dtype=np.uint64) | np.uint64(1)
WORD_KEYS = _random.integers(1, 2**63, 2 * WORDS, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=np.uint8)
    inside = ~SPACES[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.array([], dtype=np.uint64)
    lengths = ends - starts
    letters = flat[inside]
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    # Bytes are told apart by value and place; a word beyond the keys' number folds onto them, with its block counted in.
    keyed = mixed(BYTE_KEYS[letters] + PLACE_KEYS[place & 0x3FFF] + (place >> 14).astype(np.uint64))
    return mixed(np.add.reduceat(keyed, begin) + lengths.astype(np.uint64))


def word_hashes(text: str, piece: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased; long texts are cut at blanks and done in pieces."""
    raw = text.encode("utf-8", "replace").translate(LOWER)
    if len(raw) <= piece:
        return _word_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and not SPACES[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    n = len(words)
    if n < WORDS:
        if not n:
            return words
        return mixed(np.sum(words * WORD_KEYS[WORDS : WORDS + n], keepdims=True) + np.uint64(n))
    total = words[: n - WORDS + 1] * WORD_KEYS[0]
    for k in range(1, WORDS):
        total = total + words[k : n - WORDS + 1 + k] * WORD_KEYS[k]
    return np.unique(mixed(total))


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """Shingle sets of texts; the words of short texts are hashed together."""
    out: list[np.ndarray] = [np.array([], dtype=np.uint64)] * len(texts)
    for start, end in blocks([t or "" for t in texts], 1_000_000):
        own = [t or "" for t in texts[start:end]]
        if end - start == 1:
            out[start] = shingle_set(word_hashes(own[0]))
            continue
        raws = [t.encode("utf-8", "replace").translate(LOWER) for t in own]
        raw = b" ".join(raws)
        words = _word_hashes(raw)
        flat = np.frombuffer(raw, dtype=np.uint8)
        inside = ~SPACES[flat]
        starts = np.flatnonzero(inside & np.append(True, ~inside[:-1])) if len(flat) else np.array([], dtype=int)
        limits = np.cumsum([len(r) + 1 for r in raws])
        cuts = np.searchsorted(starts, limits)
        for k, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
            out[start + k] = shingle_set(words[a:b])
    return out


def probe_prefix(n, percent: int = PERCENT):
    """Tokens of a set that a smaller partner's index entry may meet."""
    return n - (percent * n + 99) // 100 + 1


def index_prefix(n: Column, percent: int = PERCENT) -> Column:
    """Tokens of a set that a partner at least as large may meet."""
    return n - F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent)) + 1


def _marked(values: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.zeros(len(values), dtype=bool)
    at = values >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def in_order(tokens: np.ndarray, bits: np.ndarray | None, percent: int) -> np.ndarray:
    """The prefix that goes into the index: unmarked tokens first, each part by hash."""
    most = probe_prefix(len(tokens), percent) if len(tokens) else 0
    marked = _marked(tokens, bits)
    if not marked.any():
        return tokens[:most]
    return np.concatenate([tokens[~marked], tokens[marked]])[:most]


def bit_map(values: DataFrame, column: str) -> np.ndarray:
    """The values' leading bits as a map of 2 ** MAP_BITS bits; it is all that reaches the driver."""
    at = F.shiftrightunsigned(F.col(column), 64 - MAP_BITS)
    bit = F.expr("shiftleft(1L, int(at & 63))")
    rows = values.select(at.alias("at")).select(F.shiftrightunsigned("at", 6).cast("int").alias("w"), bit.alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    packed = rows.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[packed["w"].to_numpy(dtype=np.int64)] = packed["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def prefixes(docs: DataFrame, percent: int, bits: np.ndarray | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp (fingerprint of the set) and the prefix of every text."""
    marks = broadcast(bits)
    docs = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    schema = docs.select("doc_id", "text_hash").schema.add("n_shingles", "long").add("fp", "binary").add("prefix", ArrayType(LongType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks([t or "" for t in texts], 1_000_000):
                sets = sets_of(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(2).slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.binary()),
                        _lists([in_order(s, marks.value, percent) for s in sets]),
                    ],
                    names=schema.names,
                )
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def text_hash() -> Column:
    """Tells rows with the same doc_id apart."""
    return F.xxhash64("text")


def fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([np.sum(tokens), np.sum(mixed(tokens ^ MIX))], dtype=np.uint64).tobytes() if len(tokens) else b""


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.array([], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def frequent_map(docs: DataFrame, percent: int, above: int = FREQUENT) -> np.ndarray:
    """The map of tokens that more than `above` prefixes hold; the number is raised until an eighth of the map holds them."""
    tokens = prefixes(docs, percent).select(F.explode("prefix").alias("token"))
    counted = stored(tokens.groupBy("token").count().where(F.col("count") > above), "frequent")
    by_size = counted.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    room = 1 << (MAP_BITS - 3)
    for k, c in sorted(by_size.collect(), reverse=True):
        room -= c
        if room < 0:
            above = 2 ** (k + 1)
            break
    return bit_map(counted.where(F.col("count") > above), "token")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens) of the wanted sets (sid, fp, least_id): the texts are read again, and those in question hashed."""
    keyed = docs.select("text", F.xxhash64("doc_id").alias("h"))
    marks = broadcast(bit_map(wanted.select(F.xxhash64("least_id").alias("h")), "h"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _marked(batch.column(1).to_numpy().view(np.uint64), marks.value)
            texts = batch.column(0).filter(pa.array(hit)).to_pylist()
            for start, end in blocks([t or "" for t in texts], 1_000_000):
                sets = sets_of(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["fp", "tokens"],
                )

    found = keyed.mapInArrow(run, "fp binary, tokens binary")
    # One row for a set: its copies that were hashed as well are equal.
    return found.groupBy("fp").agg(F.first("tokens").alias("tokens")).join(wanted.select("fp", "sid"), "fp").select("sid", "tokens")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, shared) for pairs (x, y)."""
    left = sets.select(F.col("sid").alias("x"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("sid").alias("y"), F.col("tokens").alias("ty"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "tx", "ty")

    ship()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, nx, ny = [], [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                at = np.searchsorted(t, s)
                shared.append(int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)))
                nx.append(len(s))
                ny.append(len(t))
            found = [pa.array(v, pa.int64()) for v in (nx, ny, shared)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["x", "y", "nx", "ny", "shared"])

    return both.mapInArrow(run, "x long, y long, nx long, ny long, shared long")


def linked(percent: int) -> Column:
    """shared / union >= percent / 100, in whole numbers."""
    return (100 + percent) * F.col("shared") >= percent * (F.col("nx") + F.col("ny"))


def first_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs that are looked at first: each entry with its list's most central set and with its neighbour.

    The number of pairs is at most twice that of entries.
    """
    central = live.groupBy("sid").agg(F.sum("listed").alias("score"))
    scored = live.join(central, "sid")
    pivots = scored.groupBy("token").agg(F.max(F.struct("score", "n", "sid")).alias("p"))
    to_pivot = scored.join(pivots, "token").select("sid", "n", F.col("p.sid").alias("other"), F.col("p.n").alias("m"))
    part = F.pmod(F.xxhash64("sid"), F.ceil(F.col("listed") / LIST_PART))
    order = Window.partitionBy("token", part).orderBy("n", "pos", "score", "sid")
    to_next = scored.select("sid", "n", F.lead("sid").over(order).alias("other"), F.lead("n").over(order).alias("m"))
    pairs = to_pivot.unionByName(to_next).where((F.col("sid") != F.col("other")) & _sizes("n", "m", percent))
    return pairs.select(F.least("sid", "other").alias("x"), F.greatest("sid", "other").alias("y")).distinct()


def with_components(live: DataFrame, label: DataFrame) -> DataFrame:
    """The entries (token, sid, n, pos, c, held) of lists that hold several components c; `held` is the list's length."""
    own = live.join(label, live["sid"] == label["node"], "left").select(
        "token", "sid", "n", "pos", F.coalesce("component", "sid").alias("c")
    )
    several = own.groupBy("token").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("held"), F.sum("n").alias("held_tokens")
    )
    return own.join(several.where("lo < hi").drop("lo", "hi"), "token")


def reachable(several: DataFrame, percent: int) -> DataFrame:
    """The entries that some other size in their list can be linked with, as far as sizes and positions tell.

    Sizes are compared, not sets: a list has few sizes, and of each the earliest position counts.
    """
    sizes = several.groupBy("token", "n").agg(F.min("pos").alias("pos"))
    a, b = (sizes.select("token", F.col("n").alias(f"n{i}"), F.col("pos").alias(f"pos{i}")) for i in (1, 2))
    needed = F.ceil(percent * (F.col("n1") + F.col("n2")) / F.lit(100 + percent))
    met = a.join(b, "token").where(_sizes("n1", "n2", percent) & (F.col("n2") - F.col("pos2") >= needed))
    last = met.groupBy("token", F.col("n1").alias("n")).agg(F.max(F.col("n1") - needed).alias("last"))
    return several.join(last, ["token", "n"]).where(F.col("pos") <= F.col("last")).drop("last")


def _overlap_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared tokens of every set on the left with every one on the right, by products of their incidence matrices.

    Tokens of one side alone are left out; the others go through the product some thousand at a time.
    """
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        column = np.searchsorted(common, flat)
        held = column < len(common)
        held[held] = common[column[held]] == flat[held]
        column, owner = column[held], np.repeat(np.arange(len(sets)), [len(t) for t in sets])[held]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], owner[order], len(sets)))
    for first in range(0, len(common), PRODUCT_TOKENS):
        parts = []
        for column, owner, sets in sides:
            a, b = np.searchsorted(column, [first, first + PRODUCT_TOKENS])
            part = np.zeros((sets, min(PRODUCT_TOKENS, len(common) - first)), dtype=np.float32)
            part[owner[a:b], column[a:b] - first] = 1
            parts.append(part)
        for row in range(0, len(left), STRIP_SETS):
            total[row : row + STRIP_SETS] += parts[0][row : row + STRIP_SETS] @ parts[1].T
    return total


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after further links (a, b), each named by its smallest member as in `root`."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        # The larger name of a link takes the smaller one, and all that bore it follow.
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to != to[to]).any():
            to = to[to]
        root = to[root]


def block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (set, smallest set of its component in the block) among the rows (sid, c, side, tokens) of one block pair.

    Only sets of different sides are counted against each other, and a strip of sets at a time is looked through, so the memory
    that a block pair takes is small beside its tokens' share.
    """
    rows = sorted(rows, key=lambda r: r[0])
    sids = np.array([r[0] for r in rows], dtype=np.int64)
    groups = np.array([r[1] for r in rows], dtype=np.int64)
    side = np.array([r[2] for r in rows])
    n = np.array([len(r[3]) // 8 for r in rows], dtype=np.int64)
    two = (side == 1).any()
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side == 1) if two else left
    if not left.size:
        return []
    first, second = ([np.frombuffer(rows[k][3], dtype=np.uint64) for k in at] for at in (left, right))
    shared = _overlap_counts(first, second)
    root, touched = np.arange(len(rows)), np.zeros(len(rows), dtype=bool)
    for start in range(0, len(left), STRIP_SETS):
        own = left[start : start + STRIP_SETS]
        near = (100 + percent) * shared[start : start + STRIP_SETS].astype(np.int64) >= percent * (n[own][:, None] + n[right][None, :])
        near &= groups[own][:, None] != groups[right][None, :]
        a, b = np.nonzero(near)
        a, b = own[a], right[b]
        touched[a] = touched[b] = True
        root = _joined(root, a, b)
    return [(int(sids[k]), int(sids[root[k]])) for k in np.flatnonzero(touched) if sids[k] != sids[root[k]]]


def long_list_links(several: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that join the components of long lists, with no row for a pair.

    A list is cut into blocks by hash so that a task holds a bounded number of
    sets and tokens; every two blocks meet once. A block pair returns, in place of pairs, one link for each set
    it has linked.
    """
    entries = stored(reachable(several.where(F.col("held") > SHORT_LIST), percent), "long")
    asked = entries.select("sid").distinct()
    tokens = stored(full_sets(docs, sets.join(asked, "sid", "left_semi")), "long-tokens")
    blocks_ = F.greatest(F.ceil(F.col("held") / BLOCK_SETS), F.ceil(F.col("held_tokens") / BLOCK_TOKENS)).cast("int")
    own = entries.withColumn("blocks", blocks_).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = other.select(
        "sid", "c", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    # Both blocks of a pair hold their own sets against the other's; within one block all sets meet.
    loaded = placed.join(tokens, "sid").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block = None

        def found(rows: list[tuple]) -> pa.RecordBatch:
            links = block_links(rows, percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])

        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != block:
                    if held:
                        yield found(held)
                    held, block = [], key
                held.append(tuple(row))
        if held:
            yield found(held)

    return loaded.select("block", "sid", "c", "side", "tokens").mapInArrow(run, "x long, y long")


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (x, y)."""
    ends = links.select("x", "y")
    for c in ("x", "y"):
        ends = ends.join(label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_top")), c, "left")
    merged = components(ends.select(F.coalesce("x_top", "x").alias("a"), F.coalesce("y_top", "y").alias("b")))
    merged = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = label.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = merged.join(label, merged["old"] == label["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return stored(known.unionByName(fresh), "label")


def _sizes(n: str, m: str, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def listed_tokens(live: DataFrame) -> DataFrame:
    """n and the listed prefix tokens of every set: no more than its prefix."""
    return live.groupBy("sid").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"))


def plausible(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose prefixes share enough.

    Shared tokens lie in both prefixes or behind the end of the prefix that ends
    first, so there are at most (shared prefix tokens) + max(n - prefix) of them.
    """
    for c in ("x", "y"):
        pairs = pairs.join(listed.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")), c)
    seen = F.size(F.array_intersect("tx", "ty"))
    behind = F.greatest(*[F.floor((percent * F.col(n) + 99) / 100) - 1 for n in ("nx", "ny")])
    return pairs.where((100 + percent) * (seen + behind) >= percent * (F.col("nx") + F.col("ny"))).select("x", "y")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(x, y, nx, ny, shared) of the pairs on their whole sets, stored."""
    pairs = stored(pairs, f"{name}-pairs")
    asked = pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct()
    tokens = stored(full_sets(docs, sets.join(asked, "sid", "left_semi")), f"{name}-tokens")
    return stored(overlaps(pairs, tokens), name)


def other_pairs(several: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that blocks and computed answers do not rule out."""
    salt = F.pmod(F.xxhash64("sid"), F.lit(256))
    grouped = several.groupBy("token", "n", "pos", "c", salt.alias("salt")).agg(F.collect_list("sid").alias("sids"))
    a = grouped.select("token", *[F.col(k).alias(f"{k}1") for k in ("n", "pos", "c", "sids")])
    b = grouped.select("token", *[F.col(k).alias(f"{k}2") for k in ("n", "pos", "c", "sids")])
    room = 1 + F.least(F.expr("n1 - pos1 - 1"), F.expr("n2 - pos2 - 1"))
    small_pos = F.when(F.expr("n1 < n2 or (n1 = n2 and pos1 <= pos2)"), F.col("pos1")).otherwise(F.col("pos2"))
    met = a.join(b, "token").where(
        F.expr("c1 < c2")
        & _sizes("n1", "n2", percent)
        & (room * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
        & (small_pos < index_prefix(F.least("n1", "n2"), percent))
    )
    flat = met.select(F.explode("sids1").alias("p"), "sids2").select("p", F.explode("sids2").alias("q"))
    pairs = flat.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    pairs = pairs.join(done, ["x", "y"], "left_anti")
    # d(x, y) >= d(x, q) - d(q, y) with q the set most similar to y, as far as these are computed.
    far = 1 - F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))
    both = done.select("x", "y", far.alias("d")).unionByName(done.select(F.col("y").alias("x"), F.col("x").alias("y"), far.alias("d")))
    home = both.groupBy("x").agg(F.min(F.struct("d", "y")).alias("h")).select("x", F.col("h.y").alias("q"), F.col("h.d").alias("dq"))
    for x, y in (("x", "y"), ("y", "x")):
        near = home.select(F.col("x").alias(y), "q", "dq")
        known = both.select(F.col("x").alias(x), F.col("y").alias("q"), F.col("d").alias("dx"))
        pairs = pairs.join(near, y, "left").join(known, [x, "q"], "left")
        pairs = pairs.where(F.coalesce(F.col("dx") - F.col("dq"), F.lit(0.0)) <= 1 - percent / 100 + 1e-9).select("x", "y")
    return pairs


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null for sets without shingles) and component_id of every row."""
    docs = only(docs, "doc_id", "text")
    bits = frequent_map(docs, percent)
    indexed = stored(prefixes(docs, percent, bits), "prefixes")
    filled = indexed.where(F.col("n_shingles") > 0)
    # A set goes by a number that is written down once.
    sets = filled.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    sets = stored(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    one = filled.join(sets, "fp").where(F.col("doc_id").eqNullSafe(F.col("least_id")))
    one = one.select("sid", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    entries = one.repartition("token")
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("listed"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    live = stored(entries.join(lists.where("lo < hi"), "token").select("token", "sid", "n", "pos", "listed").distinct(), "live")
    listed = stored(listed_tokens(live), "listed")
    done = verified(plausible(first_pairs(live, percent), listed, percent), docs, sets, "first")
    links = done.where(linked(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components(links)
    several = stored(with_components(live, label), "several")
    pairs = other_pairs(several.where(F.col("held") <= SHORT_LIST), done, percent)
    rest = verified(plausible(pairs, listed, percent), docs, sets, "rest").where(linked(percent)).select("x", "y")
    label = relabelled(label, rest.unionByName(long_list_links(several, docs, sets, percent)))
    named = sets.join(label, sets["sid"] == label["node"], "left").select("fp", "least_id", F.coalesce("component", "sid").alias("component"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = named.join(ids, "component").select("fp", "component", "component_id")
    found = indexed.drop("prefix").join(final, "fp", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", "component", own.alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text)."""
    return jaccard_classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every class of linked texts stays: that with the smallest doc_id. Texts without shingles all stay."""
    rows = jaccard_classes(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = rows.where("component is not null").groupBy("component").agg(first.alias("f")).select("f.doc_id", "f.text_hash")
    kept = kept.unionByName(rows.where("component is null").select("doc_id", "text_hash")).distinct()
    keyed = docs.withColumn("_hash", text_hash())
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_kept"))
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_hash"] == kept["_kept"]))
    # Rows repeated in full are copies as well.
    again = Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0))
    return found.withColumn("_k", F.row_number().over(again)).where("_k = 1").select(*docs.columns)
