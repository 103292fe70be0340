"""Snapshot diff: which rows were added, changed or removed between two listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.functions.paths import is_transient
from lakekeep.functions.scalars import minute_stamp
from lakekeep.operators.keyed import HIT, RIGHT, last_wins, match_unique

# Operation names.
ADD, DELETE, UPDATE = "ADD", "DELETE", "UPDATE"
OPS = (ADD, DELETE, UPDATE)

ATTRIBUTES = ("permission", "replication", "owner", "grp", "size")
TIME = "mtime"


def exclude_transient(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(~is_transient(path))


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = ("path",),
    compare: Sequence[str] = ATTRIBUTES,
    ignore_time: bool = False,
    order: Sequence[str] | None = None,
    path: str | None = "path",
) -> DataFrame:
    """One row per change, with column `op` in front.

    New only is ADD, old only is DELETE, both but different is UPDATE, equal
    rows vanish. The last old row of a key counts; `order` says which is last
    and defaults to the reading position `pos` where there is one. Every new
    row is compared on its own. ADD and UPDATE show the new row, DELETE the
    old one. `path=None` turns the exclusion of transient paths off.

    The new rows are joined to one old row per key, and the old rows without any new key are added:
    neither join has to hold many rows of one key, as a full join would.
    """
    if path:
        old, new = exclude_transient(old, path), exclude_transient(new, path)
    compared = [*compare, *([] if ignore_time or TIME not in new.columns else [TIME])]
    if order is None:
        order = ["pos"] if "pos" in old.columns else compared
    old = last_wins(old, keys, order)
    same = F.lit(True)
    for name in compared:
        same = same & F.col(name).eqNullSafe(F.col(RIGHT + name))
    op = F.when(F.col(HIT).isNull(), ADD).when(~same, UPDATE)
    held = match_unique(new, old, keys, "left").withColumn("op", op).where(F.col("op").isNotNull())
    gone = match_unique(old, new.select(*keys).distinct(), keys, "left_anti")
    shown = [F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns]
    return held.select("op", *new.columns).unionByName(gone.select(F.lit(DELETE).alias("op"), *shown))


def listing_line() -> Column:
    """A listing row as text, fields parted by single blanks."""
    return F.concat_ws(" ", *ATTRIBUTES, minute_stamp(TIME), "path")


def change_lines(changes: DataFrame) -> DataFrame:
    """Changes as text: ADD and UPDATE repeat the line they were read from."""
    body = listing_line()
    if "raw" in changes.columns:
        body = F.when(F.col("op") == DELETE, body).otherwise(F.coalesce("raw", body))
    return changes.select(F.concat_ws(" ", "op", body).alias("value"))
