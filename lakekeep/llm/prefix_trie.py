"""The prefix trie of conversations, rolled up by centroid decomposition.

Turns are numbered within their conversation by sums over range pieces, so a conversation
may be larger than a task. The prefix of d turns is known by the sum of hashes of its turns, each salted
with its place; equal prefixes have equal sums, and a node of the trie is a group of
conversations with the same sum.

Sums over subtrees: `span`, the number of turns that a node's members have at or below it, is a sum over the
subtree that grouping gives at once, so it serves to find centroids. Nodes with a span of
more than `PIECE` (`HIGH_PIECE` from the second round on) are set aside; below them the tree falls into pieces that fit into a task. A task splits all its pieces at
their centroids, adds the totals of the components below a centroid, and adds them along
the path from the centroid to the top of its component; each component has at most half the span, so there
are as many rounds as the span has binary digits. The nodes set aside take the totals of the pieces below
and make a smaller tree, with one conversation for each node's members, and the same is done with that one.

Defined results: rows without a conv_id belong to no conversation. A null role or text counts as
empty. Rows of one turn number stand in the order of the digest of role and text; repeated rows are turns of their own. Without
conversations there are no nodes. Columns other than the four are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.llm.common import WORD, only, ship, stored

#: Conversations that share a first one, and the most turns taken from it.
FAMILY, HEADS = 20, 4
#: The span of a piece that one task works off, at most: of all nodes, and of the nodes set aside, which are few but may be long chains.
PIECE, HIGH_PIECE = 4096, 1 << 18
#: Nodes of one task, about.
TASK_NODES = 20_000
#: Conversation numbers in one row on their way to a digest, at most.
PACKED = 4096
#: Parts of a prefix's hash; each is a sum of 32-bit numbers.
PARTS = ("k1", "k2", "k3", "k4")
FIGURES = ("n_leaves", "saved_tokens")


def _salted(place: Column, digest: Column) -> dict[str, Column]:
    """Four 32-bit hashes of a turn at its place."""
    low, high = F.xxhash64(F.lit(1), place, digest), F.xxhash64(F.lit(2), place, digest)
    bits = F.lit(0xFFFFFFFF).cast("long")
    return dict(zip(PARTS, (
        low.bitwiseAND(bits), F.shiftrightunsigned(low, 32), high.bitwiseAND(bits), F.shiftrightunsigned(high, 32),
    ), strict=True))


def _running(cut: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds the running totals (this row included) of columns of a conversation, whose rows lie in numbered pieces."""
    piece = ["conv_id", "_piece"]
    inside = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*piece).agg(*[F.sum(c).alias(f"_s{c}") for c in sums])
    bases = totals.select(*piece, *[F.coalesce(F.sum(f"_s{c}").over(earlier), F.lit(0)).alias(f"_b{c}") for c in sums])
    local = cut.withColumns({f"_l{c}": F.sum(c).over(inside) for c in sums})
    return local.join(bases, piece).select(*cut.columns, *[(F.col(f"_l{c}") + F.col(f"_b{c}")).alias(name) for c, name in sums.items()])


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, idx, digest, words, _piece): the turns of every conversation in order, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = only(rows, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    # Written once: a second pass could sample other bounds.
    cut = turns.repartitionByRange("conv_id", "turn", "digest").withColumn("_piece", F.spark_partition_id())
    placed = _running(stored(cut, "turns"), ["turn", "digest"], {"one": "_upto"})
    return placed.select("conv_id", (F.col("_upto") - 1).alias("idx"), "digest", "words", "_piece")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words, _piece, turns): conversations with the first turns of their family's first one.

    Place -1 is the row that every conversation has, whether or not it has turns; `turns` is their number.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("idx") < HEADS - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", "words"))).alias("heads")
    )
    convs = counted.withColumn("base", base).join(heads, "base", "left").withColumn("wanted", wanted.cast("long"))
    taken = F.slice(F.coalesce("heads", F.array()), F.lit(1), F.col("wanted").cast("int"))
    convs = convs.select("conv_id", "own", "wanted", F.when(F.col("heads").isNotNull(), taken).alias("heads"))
    given = F.greatest(F.size(F.coalesce("heads", F.array())), F.lit(0)).cast("long")
    convs = stored(convs.withColumn("given", given).withColumn("turns", F.col("given") + F.greatest(F.col("own") - F.col("wanted"), F.lit(0))), "convs")
    none = F.lit(None).cast("string")
    tops = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("digest"), F.lit(0).cast("long").alias("words"), F.lit(-2).alias("_piece"), "turns")
    lent = convs.select("conv_id", "turns", F.explode("heads").alias("t")).select(
        "conv_id", F.col("t.idx").alias("place"), "t.digest", "t.words", F.lit(-1).alias("_piece"), "turns"
    )
    own = turns.join(convs.select("conv_id", "wanted", "given", "turns"), "conv_id").where(F.col("idx") >= F.col("wanted")).select(
        "conv_id", (F.col("given") + F.col("idx") - F.col("wanted")).alias("place"), "digest", "words", "_piece", "turns"
    )
    return tops.unionByName(lent).unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last): every prefix of every conversation; `last` is the depth of its longest."""
    hashed = rows.withColumns({
        k: F.when(F.col("place") < 0, F.lit(0).cast("long")).otherwise(v) for k, v in _salted(F.col("place"), F.col("digest")).items()
    })
    summed = _running(hashed, ["place"], {k: f"_{k}" for k in PARTS})
    depth = F.col("place") + 1
    node = F.md5(F.concat_ws(",", *[F.col(f"_{k}").cast("string") for k in PARTS], depth.cast("string")).cast("binary"))
    above = F.md5(F.concat_ws(",", *[(F.col(f"_{k}") - F.col(k)).cast("string") for k in PARTS], F.col("place").cast("string")).cast("binary"))
    return summed.select(
        "conv_id", depth.alias("depth"), node.alias("node"), F.when(depth > 0, above).alias("parent"), "words", F.col("turns").alias("last")
    )


def centroid_sums(parent: np.ndarray, span: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sums of `weights` (nodes by figures) over the subtree of every node of a forest.

    Nodes stand with parents before children; `parent` is -1 for tops. `span` is
    a sum over subtrees in which every node counts at least 1.

    In a component, the nodes with at least half the span of its top are the path from the top to the
    centroid, the last of them.
    """
    n = len(parent)
    span, acc, out = span.astype(np.int64).copy(), np.zeros_like(weights), np.zeros_like(weights)
    above, cut = parent.tolist(), (parent < 0).tolist()
    top = list(range(n))

    def labelled(nodes: list[int]) -> None:
        for v in nodes:
            top[v] = v if cut[v] else top[above[v]]

    left = np.arange(n)
    labelled(left.tolist())
    while left.size:
        tops = np.array(top)[left]
        path = left[2 * span[left] >= span[tops]]
        centroid = np.full(n, -1)
        np.maximum.at(centroid, np.array(top)[path], path)
        of = centroid[tops]
        chosen = np.unique(of)
        is_chosen = np.zeros(n, dtype=bool)
        is_chosen[chosen] = True
        # Split: the centroid leaves, and the nodes just below it become tops.
        rest = left[~is_chosen[left]]
        path_of = centroid[np.array(top)[path]]
        up = path != path_of
        path, path_of = path[up], path_of[up]
        below = rest[(parent[rest] >= 0) & is_chosen[parent[rest]]]
        below = below[~np.array(cut)[below]]
        for v in below.tolist():
            cut[v] = True
        labelled(rest.tolist())
        totals = np.zeros_like(weights)
        np.add.at(totals, np.array(top)[rest], weights[rest])
        whole = np.zeros_like(weights)
        whole[chosen] = weights[chosen]
        np.add.at(whole, parent[below], totals[below])
        out[chosen] = acc[chosen] + whole[chosen]
        acc[path] += whole[path_of]
        span[path] -= span[path_of]
        left = rest
    return out


SOLVED = pa.schema([("node", pa.string()), ("parent", pa.string()), ("is_top", pa.bool_()), *[(f, pa.int64()) for f in FIGURES]])


def _solve(table: pa.Table) -> pa.Table:
    """The sums over subtrees of all pieces of one task."""
    table = table.sort_by("depth")
    at = {node: k for k, node in enumerate(table.column("node").to_pylist())}
    parent = np.array([at.get(p, -1) for p in table.column("parent").to_pylist()], dtype=np.int64)
    weights = np.stack([table.column(f).to_numpy() for f in FIGURES], axis=1).astype(np.int64)
    sums = centroid_sums(parent, table.column("span").to_numpy(), weights)
    columns = [table.column("node"), table.column("parent"), pa.array(parent < 0), *[pa.array(sums[:, k]) for k in range(len(FIGURES))]]
    return pa.Table.from_arrays(columns, schema=SOLVED)


def rollup(nodes: DataFrame, chains: DataFrame, piece: int = PIECE, high_piece: int = HIGH_PIECE) -> DataFrame:
    """(node, figures): the figures of `nodes` (node, parent, conv_id, depth, figures) summed over subtrees.

    `chains` (conv_id, depth, node, last) are the nodes of conversations from the
    root down; every node is on the chain of its `conv_id`.
    """
    ship()
    solved: list[DataFrame] = []
    while True:
        spans = chains.groupBy("node").agg(F.sum(F.col("last") - F.col("depth") + 1).alias("span"))
        nodes = stored(nodes.join(spans, "node"), "trie-level")
        high = nodes.where(F.col("span") > piece)
        # Spans fall from the root down, so the high nodes of a chain are its first ones.
        upper = chains.join(high.select("node"), "node", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_high"))
        chains = chains.join(upper, "conv_id", "left").withColumn("_high", F.coalesce("_high", F.lit(0)))
        tops = chains.where(F.col("depth") == F.col("_high")).select("conv_id", F.col("node").alias("_top"))
        low = nodes.where(F.col("span") <= piece).join(tops, "conv_id")
        tasks = max(1, -(-nodes.count() // TASK_NODES))
        low = low.select("node", "parent", "depth", "span", *FIGURES, F.pmod(F.hash("_top"), F.lit(tasks)).alias("_task"))
        schema = f"node string, parent string, is_top boolean, {', '.join(f'{f} long' for f in FIGURES)}"
        solved.append(stored(low.groupBy("_task").applyInArrow(_solve, schema), "trie-solved"))
        if high.isEmpty():
            break
        given = solved[-1].where("is_top").groupBy(F.col("parent").alias("node")).agg(*[F.sum(f).alias(f"_g{f}") for f in FIGURES])
        nodes = high.join(given, "node", "left").select(
            "node", "parent", "conv_id", "depth", *[(F.col(f) + F.coalesce(f"_g{f}", F.lit(0))).alias(f) for f in FIGURES]
        )
        # One conversation for each node that is left, as far as its chain is.
        kept = chains.where(F.col("depth") < F.col("_high")).join(high.select("conv_id").distinct(), "conv_id", "left_semi")
        chains = stored(kept.select("conv_id", "depth", "node", (F.col("_high") - 1).alias("last")), "trie-chains")
        piece = max(piece, high_piece)
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out.select("node", *FIGURES)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) to (node, first, ids): runs of a node's numbers as text."""
    for batch in batches:
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, start = [], 0
        for k in range(1, len(nodes) + 1):
            if k == len(nodes) or nodes[k] != nodes[start] or k - start == PACKED:
                out.append((nodes[start], ids[start], ",".join(map(str, ids[start:k]))))
                start = k
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "first", "ids"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) to (node, ends_sha256); a node's rows are hashed as they come."""
    node, state = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations (node, conv_id) that end at each node.

    Such a digest can only be made in order, so one task makes it; but numbers are
    sorted and turned to text by ranges, and the digest reads packed runs as a stream.
    """
    ship()
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    packed = ranged.mapInArrow(_packed, "node string, first long, ids string")
    dealt = packed.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return dealt.mapInArrow(_digested, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, piece: int = PIECE, high_piece: int = HIGH_PIECE) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship()
    chains = stored(prefixes(rebuilt(stored(numbered_turns(conversations), "numbered"))), "trie-prefixes")
    nodes = chains.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
    )
    nodes = stored(nodes, "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where(F.col("node").isNotNull())
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = nodes.select(
        "node", "parent", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = rollup(own, chains.select("conv_id", "depth", "node", "last"), piece, high_piece)
    digests = end_digests(chains.where(F.col("depth") == F.col("last")).select("node", "conv_id"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums, "node").join(digests, "node", "left").join(parents, "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *FIGURES, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
