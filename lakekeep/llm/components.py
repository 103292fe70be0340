"""Connected components of a link table, as a series of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (`node`, `root`) up to the top; depth is halved by each pass."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = stored(parents.join(up, "root", "left"), "roots")
        if step.where(F.col("above").isNotNull()).isEmpty():
            return parents
        parents = step.select("node", F.coalesce("above", "root").alias("root"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `component`) of every node with a link; the component is its smallest node.

    Each pass hangs every node that has a smaller neighbour below its smallest
    one, follows the trees up to their tops, and replaces the ends of all links
    by those tops, so the links shrink to nothing in a logarithmic number of
    passes. Every join goes to a side with one row per node. Links to itself
    and repeated links do no harm; links with a null end are none.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = stored(links.where((F.col("a") < F.col("b"))).distinct(), "links")
    label = None
    while not links.isEmpty():
        parents = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        tops = _roots(stored(parents, "parents"))
        if label is None:
            label = tops
        else:
            moved = tops.select(F.col("node").alias("component"), F.col("root").alias("top"))
            known = label.withColumnRenamed("root", "component").join(moved, "component", "left")
            label = known.select("node", F.coalesce("top", "component").alias("root"))
            label = stored(label.unionByName(tops.join(label, "node", "left_anti")), "labels")
        for end in ("a", "b"):
            to = tops.select(F.col("node").alias(end), F.col("root").alias("_top"))
            links = links.join(to, end, "left").withColumn(end, F.coalesce("_top", end)).drop("_top")
        links = links.where(F.col("a") != F.col("b"))
        links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = label.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    return label.select("node", F.col("root").alias("component")).unionByName(least)
