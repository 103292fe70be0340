"""Keyed building blocks that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIGHT = "_r_"
HIT = "_r_hit"


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of every key in the given order.

    Written as an aggregate, so copies of one key are folded before the
    shuffle. Rows equal in `order` are told apart by their other columns.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    kept = df.groupBy(*keys).agg(best)
    return kept.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def match_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join to a side that has one row per key; `how` is left, left_semi or left_anti.

    Columns of the right side that are no key come out prefixed with `_r_`, and
    `_r_hit` tells whether the right side had the key. The side that is held per key has one row,
    and these are the joins whose left side Spark may split when one key owns much of it.
    """
    renamed = right.select(
        *keys,
        *[F.col(c).alias(RIGHT + c) for c in right.columns if c not in keys],
        F.lit(True).alias(HIT),
    )
    return left.join(renamed, list(keys), how)
