"""Exact range join of embeddings: pairs of one label with cosine similarity from a limit up.

On unit vectors, cosine >= c is a Euclidean distance of at most
r = sqrt(2 - 2 c). Pivots are chosen by hash for every label that is too large for
one cell; each vector is at home in the cell of its nearest pivot. By
the triangle inequality a neighbour at home in another cell j is at
most 2 r farther from pivot j than from its own, so a vector is copied to
exactly the cells where d(x, p_j) - d(x, p_home) <= 2 r, and every cell is
joined by itself: home vectors against all vectors there. A pair is counted in the home cell of either end.

Cells are cut into blocks of home vectors times chunks of all vectors, so no task
holds more than a fixed number, whatever one cell holds. A block returns for each vector
how many it linked and, in place of the pairs, one link to the smallest member of its
component within the block; the links are as many as the vectors. Equal vectors are one vector with a
count.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of
different dimension do not link; repeated rows are vectors of their own and link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.llm.common import broadcast, only, ship, stored
from lakekeep.llm.components import components

COSINE = 0.98
#: A label of more vectors than this gets pivots, one for so many.
CELL = 4000
#: Pivots over all labels at most, the bound of what is broadcast.
PIVOTS = 16384
HOMES, CHUNK = 1024, 4096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are divided by their largest component first, so no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1))


def vector_classes(df: DataFrame) -> DataFrame:
    """node, label, dim, vec, copies and least_id of every distinct valid vector of a label."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    valid = df.where(F.col("label").isNotNull() & x.isNotNull() & finite & some)
    classes = valid.select("label", whole.alias("vec"), "vec_id").groupBy("label", "vec").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")
    )
    # The numbering is written down once, so that all later passes see the same.
    return stored(classes.withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id()), "vectors")


def pivots_of(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit pivots by (label, dim): every large label has one for each CELL of its vectors, at most PIVOTS in all."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    total = sizes.agg(F.sum(F.ceil(F.col("n") / CELL))).first()[0] or 0
    if not total:
        return {}
    share = min(1.0, PIVOTS / total)
    wanted = F.ceil(F.col("n") / CELL * share)
    # A few times as many by hash, then the lowest hashes of each label.
    low = F.shiftrightunsigned(F.xxhash64("node"), 33) < 8.0 * wanted / F.col("n") * float(1 << 31)
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("node"))
    chosen = classes.join(sizes, ["label", "dim"]).where(low).withColumn("k", F.row_number().over(order)).where(F.col("k") <= wanted)
    found: dict[tuple, list] = {}
    for row in chosen.orderBy("label", "dim", "k").limit(2 * PIVOTS).toLocalIterator():
        found.setdefault((row["label"], row["dim"]), []).append(row["vec"])
    out = {}
    for key, rows in found.items():
        out[key] = unit(np.array(rows, dtype=np.float64))
    return out


def placed(classes: DataFrame, radius: float) -> DataFrame:
    """Every vector in its home cell and in those across a boundary that its neighbours may be at home in."""
    pivots = broadcast(pivots_of(classes))

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            cells, homes, at, vecs = [], [], [], []
            keys = {}
            for k, key in enumerate(zip(rows["label"], rows["dim"], strict=True)):
                keys.setdefault(key, []).append(k)
            for key, ks in keys.items():
                m = np.array([rows["vec"][k] for k in ks], dtype=np.float64)
                near = pivots.value.get(key)
                if near is None:
                    home, there = np.zeros(len(ks), dtype=int), np.ones((len(ks), 1), dtype=bool)
                else:
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * unit(m) @ near.T))
                    home = d.argmin(axis=1)
                    there = d - d[np.arange(len(ks)), home][:, None] <= 2 * radius + 1e-7
                i, j = np.nonzero(there)
                cells.extend(j.tolist())
                homes.extend((home[i] == j).tolist())
                at.extend(ks[k] for k in i)
                packed = [v.tobytes() for v in m]
                vecs.extend(packed[k] for k in i)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("label", "dim", "node", "copies")]
                + [pa.array(cells, pa.int32()), pa.array(homes, pa.bool_()), pa.array(vecs, pa.binary())],
                names=["label", "dim", "node", "copies", "cell", "home", "vec"],
            )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "node", "copies", "vec").mapInArrow(
        run, f"label {label}, dim int, node long, copies long, cell int, home boolean, vec binary"
    )


def joined_block(cosine: float):
    """Links of one block: its home vectors against its chunk."""

    def join(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        vecs = table.column("vec").to_pylist()
        h, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out_node = np.array([], dtype=np.int64)
        out_links = out_root = out_node
        if h.size and c.size:
            near = unit_rows([vecs[k] for k in h]) @ unit_rows([vecs[k] for k in c]).T >= cosine
            near &= node[h][:, None] != node[c][None, :]
            links = near @ copies[c]
            i, j = np.nonzero(near)
            names, back = np.unique(np.concatenate([node[h], node[c]]), return_inverse=True)
            a, b = back[: len(h)][i], back[len(h) :][j]
            root = np.arange(len(names))
            while a.size:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            touched = np.unique(np.concatenate([a, b]))
            at = np.zeros(len(names), dtype=np.int64)
            at[back[: len(h)]] = links
            out_node, out_links, out_root = names[touched], at[touched], names[root[touched]]
        return pa.table({"node": out_node, "links": pa.array(out_links, pa.int64()), "root": out_root})

    return join


def metric_components(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `df` (vec_id, embedding, label)."""
    ship()
    rows = only(df, "vec_id", "embedding", "label")
    classes = vector_classes(rows)
    cells = stored(placed(classes, math.sqrt(max(0.0, 2 - 2 * cosine))), "cells")
    held = cells.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / HOMES).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")
    )
    cells = cells.join(held, ["label", "dim", "cell"]).where(F.col("blocks") > 0)
    key = F.xxhash64("node")
    block, chunk = F.pmod(key, F.col("blocks")).cast("int"), F.pmod(F.shiftright(key, 20), F.col("chunks")).cast("int")
    shared = ["label", "dim", "cell", "node", "copies", "vec"]
    homes = cells.where("home").select(*shared, F.lit(0).alias("side"), block.alias("b"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("c"))
    every = cells.select(*shared, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), chunk.alias("c"))
    found = homes.unionByName(every).groupBy("label", "dim", "cell", "b", "c").applyInArrow(
        joined_block(cosine), "node long, links long, root long"
    )
    found = stored(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = classes.select("node", "label", "vec", "copies", "least_id").join(links, "node", "left").join(label, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least_id").alias("_least"))
    nodes = nodes.join(least, "component").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "_least"
    )
    whole = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    all_rows = rows.withColumn("_whole", whole)
    matched = all_rows.join(nodes, (all_rows["label"] == nodes["_label"]) & (all_rows["_whole"] == nodes["_vec"]), "left")
    return matched.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_least", "vec_id").cast("long").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
