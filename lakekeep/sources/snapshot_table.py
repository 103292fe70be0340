"""Snapshots kept as catalog tables, bucketed and sorted by their key, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.operators.diff import ADD, ATTRIBUTES, DELETE, TIME, UPDATE, exclude_transient
from lakekeep.operators.keyed import last_wins

BUCKETS = 200


def store_snapshot(
    rows: DataFrame, table: str, path: str, buckets: int = BUCKETS, keys: Sequence[str] = ("path",), order: Sequence[str] | None = None
) -> None:
    """Write the last row of every key as an external table at `path`.

    This is the one time that the snapshot is shuffled: later diffs and syncs read its buckets as they lie. `order` is as in
    `snapshot_diff`.
    """
    if order is None:
        compared = [c for c in (*ATTRIBUTES, TIME) if c in rows.columns]
        order = ["pos"] if "pos" in rows.columns else compared
    kept = last_wins(rows, keys, order)
    # A task for each bucket, and so a file for each.
    dealt = kept.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)


def stored_diff(
    spark: SparkSession, table: str, new: DataFrame, keys: Sequence[str] = ("path",), compare: Sequence[str] = ATTRIBUTES,
    ignore_time: bool = False, path: str | None = "path",
) -> DataFrame:
    """`snapshot_diff` of a stored snapshot and new rows, of which the new ones alone are shuffled.

    The new rows are joined to the old ones bucket by bucket, and old ones without a new key are those that no new key meets.
    """
    old = spark.table(table)
    if path:
        old, new = exclude_transient(old, path), exclude_transient(new, path)
    compared = [*compare, *([] if ignore_time or TIME not in new.columns else [TIME])]
    was = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in compared], F.lit(True).alias("_old_hit"))
    same = F.lit(True)
    for name in compared:
        same = same & F.col(name).eqNullSafe(F.col(f"_old_{name}"))
    op = F.when(F.col("_old_hit").isNull(), ADD).when(~same, UPDATE)
    held = new.join(was, list(keys), "left").withColumn("op", op).where(F.col("op").isNotNull())
    gone = old.join(new.select(*keys), list(keys), "left_anti")
    shown = [F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns]
    return held.select("op", *new.columns).unionByName(gone.select(F.lit(DELETE).alias("op"), *shown))
