"""Running totals over an ordered group that may be larger than one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.session import pinned


def running_before(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str
) -> DataFrame:
    """Adds `name`: the total weight of the rows before this one in its group.

    Rows are range-partitioned by group and order, which cuts a huge group into
    many even pieces; the remaining columns break ties, so that many rows of one
    place can be cut as well. Null groups and places count as any other. The cut is written out once, since a second pass could
    sample other bounds. A piece is then totalled on its own and shifted by the
    sum of the earlier pieces of its group; a group has no more pieces than
    there were range partitions.
    """
    ties = [c for c in df.columns if c not in (*group, *order)]
    ranged = df.repartitionByRange(*group, *order, *ties)
    cut = pinned(ranged.withColumn("_piece", F.spark_partition_id()), "ranges")
    piece = [*group, "_piece"]
    sums = cut.groupBy(*piece).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*piece).orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    bases = bases.select("_base", *[F.col(c).alias(f"_b{c}") for c in piece])
    same = F.lit(True)
    for c in piece:
        same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    return (
        cut.withColumn("_local", local)
        .join(bases, same)
        .withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint"))
        .select(*df.columns, name)
    )
