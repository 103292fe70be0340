"""Shards cut from a Hilbert curve over several metadata dimensions.

Equal texts are a class, which has one place: the source and language of its
least doc_id, its size, and that doc_id. These are quantised to 2 ** BITS levels each: text
columns by their rank among the distinct values, numbers by quantiles. Classes
are sorted by the index of their cell on the Hilbert curve through the four dimensions, then by the digest of their text, and
the rows are cut into runs of equal counts (the law `rows`). So a shard covers a
compact region, files are pruned by any of the dimensions, and a class is cut only where a boundary falls into it.

Ranks are exact and no order is global: cells (at most 2 ** (4 * BITS), counted
and broadcast) tell where each cell starts, stretches of a cell (by the first digits of the digest) where each stretch starts, classes
are ordered within a stretch, and the rows of a class within parts by id hash.

Defined results: null texts have size 1 (no bytes, plus 1) and the checksum and class of
the empty text; null sources, languages and ids are a level of their own, and a class has a null id only where no row has one. Repeated rows get slots of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekeep.llm.common import only, stored

BITS = 4
#: Digits of a text's digest that make a stretch of a cell, and parts of the rows of one text.
STRETCH, PARTS = 4, 1024
DIMENSIONS = ("source", "lang", "size", "doc_id")


def curve_index(axes: list[Column], bits: int, df: DataFrame, name: str = "curve") -> DataFrame:
    """`df` with the index of the cell with these coordinates on the Hilbert curve (transposed Gray-code form)."""
    n = len(axes)
    x = [f"_x{i}" for i in range(n)]
    df = df.withColumns({c: a.cast("int") for c, a in zip(x, axes, strict=True)})
    for q in reversed(range(1, bits)):
        low = (1 << q) - 1
        for c in x:
            set_ = F.col(c).bitwiseAND(1 << q) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            first = F.when(set_, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            own = F.when(set_, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))
            df = df.withColumns({x[0]: first} if c == x[0] else {x[0]: first, c: own})
    for a, b in zip(x, x[1:], strict=False):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn = reduce(
        lambda t, q: t.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << q) != 0, (1 << q) - 1).otherwise(0)),
        range(1, bits), F.lit(0),
    )
    df = df.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for q in reversed(range(bits)):
        for c in x:
            bit = F.shiftright(F.col(c).bitwiseXOR(F.col("_turn")), q).bitwiseAND(1)
            index = index * 2 + bit
    return df.withColumn(name, index).drop(*x, "_turn")


def _by_rank(df: DataFrame, column: str, levels: int) -> DataFrame:
    """The distinct values of a text column with their level; null is last."""
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col(column).asc_nulls_last())
    rank = F.row_number().over(order) - 1
    most = F.count(F.lit(1)).over(Window.partitionBy())
    level = F.least(F.floor(rank * levels / F.greatest(most, F.lit(levels))), F.lit(levels - 1)).cast("int")
    return values.select(F.col(column).alias(f"_{column}"), level.alias(f"_level_{column}"))


def _by_quantile(column: str, cuts: list) -> Column:
    """How many of the cuts lie at or below the value; 0 for null."""
    return F.coalesce(sum((F.col(column) >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0), F.lit(0))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size, text_crc32 and digest of every document."""
    docs = only(docs, "doc_id", "text", "source", "lang")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(
        "doc_id", "source", "lang", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("digest"),
    )


def _before(group: list[str], order: str, count: str) -> Column:
    """The counts of the rows before this one in its group; groups are bounded or dealt out."""
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))


def classes_of(rows: DataFrame) -> DataFrame:
    """digest, held (rows), size, and source, lang and doc_id of the row with the least doc_id, for every different text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")).alias("first")
    held = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("held"), F.min("size").alias("size"), first)
    return held.select("digest", "held", "size", "first.doc_id", "first.source", "first.lang")


def in_cells(classes: DataFrame, bits: int) -> DataFrame:
    """(digest, held, cell): the classes with their cells."""
    levels = 1 << bits
    shares = F.array(*[F.lit(k / levels) for k in range(1, levels)])
    cuts = classes.agg(*[F.percentile_approx(c, shares, 100_000).alias(c) for c in ("size", "doc_id")]).first()
    for column in ("source", "lang"):
        to = _by_rank(classes, column, levels)
        classes = classes.join(to, classes[column].eqNullSafe(to[f"_{column}"]), "left").drop(f"_{column}")
    for column in ("size", "doc_id"):
        classes = classes.withColumn(f"_level_{column}", _by_quantile(column, sorted(set(cuts[column] or []))))
    cell = F.lit(0)
    for column in DIMENSIONS:
        cell = cell * levels + F.coalesce(F.col(f"_level_{column}"), F.lit(0))
    return classes.select("digest", "held", cell.cast("int").alias("cell"))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve (the cell's index) of every row."""
    return placed(docs, shards, bits).drop("digest", "source", "lang")


def placed(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """As `hilbert_shards`, with digest, source and lang."""
    levels = 1 << bits
    rows = stored(metadata(docs), "hilbert-meta")
    n = max(1, rows.count())
    classes = stored(in_cells(stored(classes_of(rows), "hilbert-classes"), bits), "hilbert-cells")
    classes = classes.withColumn("stretch", F.substring("digest", 1, STRETCH))
    stretches = stored(classes.groupBy("cell", "stretch").agg(F.sum("held").alias("in_stretch")), "hilbert-stretches")
    cells = stretches.groupBy("cell").agg(F.sum("in_stretch").alias("in_cell"))
    axes = [F.shiftright("cell", bits * (len(DIMENSIONS) - 1 - k)).bitwiseAND(levels - 1) for k in range(len(DIMENSIONS))]
    cells = curve_index(axes, bits, cells)
    # At most 2 ** (4 * BITS) = 65,536 rows of three numbers.
    cells = cells.select("cell", "curve", _before([], "curve", "in_cell").alias("cell_start"))
    starts = stretches.select("cell", "stretch", _before(["cell"], "stretch", "in_stretch").alias("stretch_start")).join(F.broadcast(cells), "cell")
    starts = starts.select("cell", "stretch", "curve", (F.col("cell_start") + F.col("stretch_start")).alias("stretch_start"))
    ordered = classes.join(starts, ["cell", "stretch"])
    first = F.col("stretch_start") + _before(["cell", "stretch"], "digest", "held")
    ordered = ordered.select("digest", "curve", first.alias("class_start"))

    # The rows of a class by id hash, so that many equal texts are many tasks' work.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("in_part"))
    parts = parts.join(ordered, "digest").select("digest", "part", "curve", (F.col("class_start") + _before(["digest"], "part", "in_part")).alias("part_start"))
    inside = Window.partitionBy("digest", "part").orderBy("doc_id", "source", "lang")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1).join(parts, ["digest", "part"])
    numbered = numbered.withColumn("rank", F.col("part_start") + F.col("_k")).withColumn("shard", F.expr(f"int(rank * {shards} div {n})"))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", "digest", "source", "lang",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = BITS) -> None:
    """Write whole documents to `<path>/data/shard=<n>` in slot order, and to `<path>/ranges` what each shard holds of every dimension."""
    places = stored(placed(docs, shards, bits), "hilbert-placed")
    key = ["doc_id", "digest"]
    # Rows of one id and text are told apart by their number, in the same order on both sides.
    alike = Window.partitionBy("digest", "doc_id").orderBy("source", "lang")
    at = places.withColumn("_n", F.row_number().over(alike)).select(*[F.col(c).alias(f"_{c}") for c in key], "_n", "shard", "slot")
    named = docs.withColumn("digest", F.md5(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))).withColumn("_m", F.row_number().over(alike))
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_m") == F.col("_n"))
    whole = named.join(at, same).drop("digest", "_m", "_n", *[f"_{c}" for c in key])
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/data")
    held = places.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{name}_{c}") for c in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))],
    )
    held.coalesce(1).write.parquet(f"{path}/ranges")


def read_shards(spark: SparkSession, path: str, **bounds: tuple) -> DataFrame:
    """Rows of written shards whose dimensions lie within `bounds` (name: (least, most)); shards that cannot have one are not read."""
    ranges, wanted, hit = spark.read.parquet(f"{path}/ranges"), F.lit(True), F.lit(True)
    for name, (least, most) in bounds.items():
        wanted = wanted & (F.col(f"max_{name}") >= F.lit(least)) & (F.col(f"min_{name}") <= F.lit(most))
        value = F.octet_length(F.coalesce("text", F.lit(""))) + 1 if name == "size" else F.col(name)
        hit = hit & value.between(F.lit(least), F.lit(most))
    # One number for each shard.
    kept = [r["shard"] for r in ranges.where(wanted).select("shard").collect()]
    schema = spark.read.parquet(f"{path}/data").schema
    if not kept:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/shard={s}" for s in sorted(kept)])
    return rows.where(hit)
