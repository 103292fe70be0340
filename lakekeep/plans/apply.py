"""Apply a change set to a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakekeep.functions.paths import is_file
from lakekeep.operators.diff import ADD, DELETE, OPS, UPDATE
from lakekeep.operators.keyed import HIT, RIGHT, last_wins, match_unique
from lakekeep.operators.usage import file_flag
from lakekeep.plans.actions import KIND_CONFLICT, SOURCE_MISSING, UNKNOWN_OP, delete_rows, observed
from lakekeep.session import pinned


class Applied(NamedTuple):
    snapshot: DataFrame
    failures: DataFrame


def _order(df: DataFrame, order: Sequence[str] | None) -> list[str]:
    if order is not None:
        return list(order)
    return [c for c in ("pos", "idx") if c in df.columns][:1]


def fold_changes(
    changes: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """(keys, op, carry): the last change of every key."""
    by = _order(changes, order)
    wanted = dict.fromkeys(["op", *by, *carry])
    told = last_wins(changes.select(*keys, *[c for c in wanted if c not in keys]), keys, by)
    return told.select(*keys, "op", *[c for c in carry if c not in keys])


def decide(target: DataFrame, source: DataFrame, told: DataFrame, keys: Sequence[str] = ("path",), tree: bool = False) -> DataFrame:
    """What becomes of every change of `told`: its `reason` to fail, if any, and the source row as `_r_` columns.

    Every decision depends on its own key alone, so any part of the changes can be decided apart from the others.
    """
    keys, columns = list(keys), target.columns
    # Only changed rows of the source are worth a shuffle.
    fresh = source.select(*columns, *[c for c in _order(source, None) if c not in columns])
    fresh = match_unique(fresh, told.select(*keys), keys, "left_semi")
    fresh = last_wins(fresh, keys, _order(source, None)).select(*columns)
    if tree:
        fresh = fresh.withColumn("_file", file_flag(fresh))
    decided = match_unique(told, fresh, keys, "left")
    builds = F.col("op").isin(ADD, UPDATE)
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    reason = F.when(~known, UNKNOWN_OP).when(builds & F.col(HIT).isNull(), SOURCE_MISSING)
    if tree:
        held = target.select(*keys, file_flag(target).alias("held_file")).groupBy(*keys)
        decided = decided.join(held.agg(F.max("held_file").alias("held_file")), keys, "left")
        conflict = builds & F.col(RIGHT + "_file") & ~F.col("held_file")
        reason = reason.when(conflict, KIND_CONFLICT)
    return decided.withColumn("reason", reason)


def settle(target: DataFrame, decided: DataFrame, keys: Sequence[str] = ("path",), tree: bool = False) -> DataFrame:
    """The snapshot after stored decisions.

    With `tree` the DELETE of a folder takes every row of the target below it, whether or not a change names it, but
    for rows whose own change failed.
    """
    keys, columns = list(keys), target.columns
    made = decided.where(F.col("reason").isNull())
    kept = target
    if tree:
        folders = made.where((F.col("op") == DELETE) & ~F.col("held_file"))
        folders = folders.select("path", F.lit(False).alias("is_file"))
        failed = decided.where(F.col("reason").isNotNull()).select(*keys)
        spared = match_unique(target, failed, keys, "left_semi")
        kept = delete_rows(match_unique(target, failed, keys, "left_anti"), folders, True).unionByName(spared)
    kept = match_unique(kept, made.select(*keys), keys, "left_anti")
    taken = made.where(F.col("op").isin(ADD, UPDATE)).select(*[F.col(c) if c in keys else F.col(RIGHT + c).alias(c) for c in columns])
    return kept.unionByName(taken)


def lined(decided: DataFrame) -> DataFrame:
    """Decisions as job counters take them; a row without a permission is a file."""
    kind = F.coalesce(is_file(RIGHT + "permission"), F.lit(True)) if RIGHT + "permission" in decided.columns else F.lit(True)
    return decided.withColumns({"skipped": F.lit(False), "file": kind})


def failures_in(decided: DataFrame, keys: Sequence[str] = ("path",), carry: Sequence[str] = ()) -> DataFrame:
    return decided.where(F.col("reason").isNotNull()).select(*keys, "op", "reason", *[c for c in carry if c not in keys])


def apply_changes(
    target: DataFrame,
    source: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = ("path",),
    order: Sequence[str] | None = None,
    tree: bool = False,
    carry: Sequence[str] = (),
    observation: Observation | None = None,
) -> Applied:
    """The snapshot after the changes, and the changes that could not be made.

    ADD and UPDATE take the source row, DELETE removes the target row. The last
    change of a key counts, as does its last source row. A change whose source
    row is gone fails, as does one of an unknown op, and the target row is kept. With `tree` the rows are
    files and folders: a file over a folder fails too, and the DELETE of a
    folder takes what lies below it, but for rows whose own change failed. Failures carry
    the columns `carry` of their changes. An `observation` is told the job
    counters by the job that stores the decisions.
    """
    told = fold_changes(changes, keys, order, carry)
    # The decisions feed every part of the result, so they are stored once.
    decided = decide(target, source, told, keys, tree)
    if observation is not None:
        decided = observed(lined(decided), observation).select(*decided.columns)
    decided = pinned(decided, "decided")
    return Applied(settle(target, decided, keys, tree), failures_in(decided, keys, carry))
