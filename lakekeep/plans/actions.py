"""What a list of changes will do: outcomes per line, steps, counters, source deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakekeep.functions.paths import (
    ancestors, is_file, is_transient, is_trash, lineage, parent, protected, target_path,
)
from lakekeep.functions.scalars import minute_stamp, mode_of
from lakekeep.operators.diff import ADD, DELETE, OPS, UPDATE
from lakekeep.operators.keyed import HIT, match_unique
from lakekeep.operators.usage import file_flag
from lakekeep.operators.verify import MATCH

# Job types and failure reasons.
COPY, VERIFY, REMOVE = "copy", "verify", "delete"
JOBS = (COPY, VERIFY, REMOVE)
UNKNOWN_OP, KIND_CONFLICT, SOURCE_MISSING = "unknown_op", "kind_conflict", "source_missing"
BAD_MODE = "bad_mode"


def check_job(job: str) -> str:
    if job not in JOBS:
        raise ValueError(f"unknown job: {job}")
    return job


def kinds_of(inv: DataFrame) -> DataFrame:
    """(path, is_file), one row per path."""
    return inv.select("path", file_flag(inv).alias("is_file")).groupBy("path").agg(
        F.max("is_file").alias("is_file")
    )


def outcomes(
    changes: DataFrame, target: DataFrame, job: str = COPY, verified: DataFrame | None = None
) -> DataFrame:
    """Adds to every change line what becomes of it.

    `file`: the line names a file. `present`, `target_file`: state of the
    target path before the change. `skipped`: the path is left alone, which
    are transient paths for a copy job and the trash for a verify job.
    `reason`: why the line fails, null when it does not. A verify job fails where
    `verified` (path, status) tells of a path that is no match. Lines of a wrong arity
    have a null `op`; they neither succeed nor fail.
    """
    if check_job(job) == REMOVE:
        raise ValueError("source deletes are planned by plan_source_delete")
    seen = match_unique(changes, kinds_of(target), ["path"], "left")
    skipped = is_transient("path") if job == COPY else is_trash("path")
    file = is_file("permission")
    target_file = F.coalesce(F.col("_r_is_file"), F.lit(False))
    present = F.col(HIT).isNotNull()
    live = F.col("op").isNotNull() & ~skipped
    builds = F.col("op").isin(ADD, UPDATE)
    if job == COPY:
        unreadable = builds & mode_of("permission").isNull()
        blocked = builds & file & present & ~target_file
        reason = F.when(live, F.when(~F.col("op").isin(*OPS), UNKNOWN_OP).when(unreadable, BAD_MODE).when(blocked, KIND_CONFLICT))
    elif verified is not None:
        told = verified.where(F.col("status") != MATCH).select("path", F.lower("status").alias("_status")).dropDuplicates(["path"])
        seen = seen.join(told, "path", "left")
        reason = F.when(live & builds, F.col("_status"))
    else:
        reason = F.lit(None).cast("string")
    return seen.select(
        *changes.columns,
        file.alias("file"),
        present.alias("present"),
        target_file.alias("target_file"),
        (F.col("op").isNotNull() & skipped).alias("skipped"),
        reason.alias("reason"),
    )


def _step(seq: int, action: str, when: Column, arg: Column | None = None) -> Column:
    arg = F.lit(None).cast("string") if arg is None else arg
    return F.when(
        when, F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), arg.alias("arg"))
    )


def plan_actions(outcome: DataFrame, target_root: str = "/") -> DataFrame:
    """One row per step that the lines of `outcomes` imply.

    A transient path gives SKIP, a failing line FAIL with its reason. ADD
    copies a file or makes a missing folder, then sets owner, mode and times.
    UPDATE removes a target file first. DELETE removes what is there.
    """
    op = F.col("op")
    fails = F.col("reason").isNotNull()
    live = ~F.col("skipped") & ~fails
    builds = live & op.isin(ADD, UPDATE)
    replaces = live & (op == UPDATE) & F.col("target_file")
    makes = builds & ~F.col("file") & (~F.col("present") | replaces)
    steps = F.array(
        _step(0, "SKIP", F.col("skipped")),
        _step(0, "FAIL", fails, F.col("reason")),
        _step(1, "DELETE", replaces | (live & (op == DELETE) & F.col("present"))),
        _step(2, "COPY", builds & F.col("file")),
        _step(2, "MKDIR", makes),
        _step(3, "CHOWN", builds, F.concat_ws(":", "owner", "grp")),
        _step(4, "CHMOD", builds, mode_of("permission")),
        _step(5, "TIMES", builds, minute_stamp("mtime")),
    )
    exploded = outcome.where(op.isNotNull()).withColumn("s", F.explode(steps))
    return exploded.where(F.col("s").isNotNull()).select(
        "path", target_path(target_root, "path").alias("target"), "op", "s.seq", "s.action", "s.arg"
    )


def counter_columns(job: str = COPY) -> list[Column]:
    """The job counters as aggregates over lines with `op`, `reason`, `skipped` and `file`, for a delete job also `doomed`.

    A skipped line succeeds without counting as an operation. MKDIR counts
    every folder line, whether or not the folder was there. A verify job makes no
    changes and so counts none; a delete job counts what it removes.
    """
    op = F.col("op")
    known = op.isNotNull()
    failed = F.col("reason").isNotNull()
    done = known & ~failed & ~F.col("skipped")
    none = F.lit(False)
    copies, removes = check_job(job) == COPY, job == REMOVE
    builds = done & op.isin(ADD, UPDATE)
    counts = {
        "total": F.lit(True),
        "succ": known & ~failed,
        "fail": failed,
        "invalid": ~known,
        "added": done & (op == ADD) if copies else none,
        "deleted": done & (op == DELETE) if copies else F.col("doomed") if removes else none,
        "updated": done & (op == UPDATE) if copies else none,
        "mkdir": builds & ~F.col("file") if copies else none,
        "copied": builds & F.col("file") if copies else none,
        "reduced": failed,
    }
    return [F.count_if(c).cast("bigint").alias(n) for n, c in counts.items()]


COUNTERS = ("total", "succ", "fail", "invalid", "added", "deleted", "updated", "mkdir", "copied", "reduced")


def counters(outcome: DataFrame, job: str = COPY) -> DataFrame:
    """One row of job counters over the lines of `outcomes`, or of `delete_outcomes` for a delete job."""
    return outcome.agg(*counter_columns(job))


def delete_outcomes(changes: DataFrame, src: DataFrame, recursive: bool = False) -> DataFrame:
    """What becomes of every line of a delete job: adds `file`, `skipped`, `doomed` and `reason`.

    A line whose source path is removed is `doomed`; all other known lines are skipped.
    """
    doomed = plan_source_delete(changes, src, recursive)
    seen = match_unique(changes, doomed, ["path"], "left")
    hit = F.col(HIT).isNotNull() & F.col("op").isNotNull()
    return seen.select(
        *changes.columns, is_file("permission").alias("file"), (F.col("op").isNotNull() & ~hit).alias("skipped"),
        hit.alias("doomed"), F.lit(None).cast("string").alias("reason"),
    )


def observed(outcome: DataFrame, observation: Observation | str, job: str = COPY) -> DataFrame:
    """The same lines, which tell their job counters to the observation, or to listeners by its name, as they are worked off.

    The counters come with the job that writes the lines; there is no second pass. They hold for one action on the result.
    """
    return outcome.observe(observation, *counter_columns(job))


def plan_source_delete(
    changes: DataFrame, src: DataFrame, recursive: bool = False, ops: Sequence[str] | None = None
) -> DataFrame:
    """(path, is_file) of what a delete after migration removes from the source.

    Every listed path that still exists and is not protected: files always,
    folders only if `recursive`, and then no folder above a protected path. The op of a line does not matter unless `ops`
    names the wanted ones. Both sides are folded to one row per path before
    they meet.
    """
    listed = changes.where(F.col("op").isNotNull() if "op" in changes.columns else F.lit(True))
    if ops is not None:
        listed = listed.where(F.col("op").isin(*ops))
    wanted = listed.where(~protected("path")).select("path").distinct()
    hits = kinds_of(src).join(wanted, "path", "left_semi")
    if not recursive:
        return hits.where("is_file")
    held = src.select("path").unionByName(src.select(parent("path").alias("path")).distinct()).where(protected("path"))
    above = held.distinct().select(F.explode(ancestors("path")).alias("path")).distinct()
    return hits.join(above, "path", "left_anti")


def below(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """(leaf): the parent folders of `rows` that are, or lie below, one of `folders`.

    Only distinct folders climb to their ancestors. A folder near the top is an
    ancestor of nearly all of them; that side of the join Spark may split.
    """
    leaves = rows.select(parent("path").alias("leaf")).distinct()
    climbed = leaves.select("leaf", F.explode(lineage("leaf")).alias("path"))
    wanted = folders.select("path").distinct()
    return match_unique(climbed, wanted, ["path"], "left_semi").select("leaf").distinct()


def delete_rows(src: DataFrame, doomed: DataFrame, recursive: bool = False) -> DataFrame:
    """Rows of `src` that survive the deletes of `plan_source_delete`."""
    paths = doomed.select("path").distinct()
    left = match_unique(src, paths, ["path"], "left_anti")
    if not recursive:
        return left
    gone = below(src, doomed.where(~F.col("is_file")))
    owned = left.withColumn("leaf", parent("path"))
    return match_unique(owned, gone, ["leaf"], "left_anti").select(*src.columns)
