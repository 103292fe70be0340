"""Mixing sources to target weights as a time-varying curriculum.

Targets: sources, ordered by code point with null last, weigh 5, 2, 1,
repeating, and share the words of all documents; a target stops at `most` times the
words of its source, and the rest is shared again by weight. The level at
which this settles is found in one pass over the sources, ordered by how soon they fill up.

Training positions: over training time t in [0, 1] a source has the weight
w(t) = W (1 + g (1 - 2 t)). Its demand up to t is the target times the integral
t + g t (1 - t); with g in [-1, 1] that has an inverse, which gives every copy
of a document the time at which the source's demand reaches it. Within a source
documents are taken in the order of md5(doc_id), whole rounds first, then as
many of one more round as come nearest to the target.

No source is ever in one task: rows are dealt by source and leading digits of
the md5, sums per part are added up on the small side, and each part counts from
its own start.

Defined results: null texts have size 0 and are taken with 0 words; a source without words
has target 0; an empty table gives an empty result. Rows repeated in full are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.llm.common import WORD, stored

WEIGHTS, MOST = (5, 2, 1), 3
#: How a weight moves over training, by place in WEIGHTS: falling, level, rising.
SLOPES = (0.5, 0.0, -0.5)
#: Leading hex digits of the order key that deal a source out to parts.
DIGITS = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, weight, slope and target from source and source_size."""
    everything = Window.partitionBy()
    ranked = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    place = F.col("k") % len(WEIGHTS)
    ranked = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double"),
            "slope": F.element_at(F.array(*map(F.lit, SLOPES)), (place + 1).cast("int")),
            "cap": (F.col("source_size") * MOST).cast("double"),
        }
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0.0))
    total = lambda c: F.sum(c).over(everything)
    level = (total("source_size") - before("cap")) / F.nullif(total("weight") - before("weight"), F.lit(0.0))
    ranked = ranked.withColumn("level", level)
    # The first source, by how soon it fills up, that the level leaves unfilled sets the level for the rest.
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))
    settled = F.min(open_).over(everything).getField("level")
    share = F.coalesce(settled * F.col("weight"), F.col("cap"))
    return ranked.select("source", "source_size", "weight", "slope", F.least("cap", share).alias("target"))


def moment(u: Column, slope: Column) -> Column:
    """The time at which the integral t + g t (1 - t) reaches u."""
    return 2 * u / ((1 + slope) + F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * u, F.lit(0.0))))


def mix(docs: DataFrame) -> DataFrame:
    """`docs` with size, source_size, target, copies, taken and positions (one training position a copy).

    `docs` has doc_id, source and text, or a ready `size` in place of a text; further columns are kept.
    """
    if "size" not in docs.columns:
        docs = docs.withColumn("size", words())
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumn("_order", order)
    # One key for the shares of a source, so that counting within them and joining to their starts take one shuffle.
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    docs = docs.withColumn("_part", F.concat(F.substring("_order", 1, DIGITS), source))
    parts = stored(docs.groupBy("source", "_part").agg(F.sum("size").alias("part_size")), "mix-parts")
    sources = stored(targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(
        "_part", "start", "source_size", "slope", "target"
    )
    inside = Window.partitionBy("_part").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, "_part")
    size, whole = F.col("size"), F.col("source_size")
    rounds = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0)
    placed = placed.withColumn("_before", F.col("start") + F.col("_inside")).withColumn("_rounds", rounds.cast("long"))
    extra = (F.col("_before") + size / 2 <= F.col("target") - F.col("_rounds") * whole) & (F.col("_rounds") < MOST)
    placed = placed.withColumn("copies", F.when(size > 0, F.col("_rounds") + extra.cast("long")).otherwise(0))
    reached = lambda c: F.least(F.lit(1.0), (c * F.col("source_size") + F.col("_before")) / F.col("target"))
    positions = F.when(
        F.col("copies") > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda c: moment(reached(c), F.col("slope"))),
    ).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn("positions", positions).withColumn("taken", size * F.col("copies"))
    helpers = [c for c in placed.columns if c.startswith("_") and c in {"_order", "_part", "_inside", "_before", "_rounds"}]
    return placed.drop(*helpers, "start", "slope")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for every copy taken, range-sorted by its training position."""
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions", "copies", "taken")
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
