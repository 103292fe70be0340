"""Very many renamings, done by tasks from a stored plan.

The plan (source, goal) is written before anything is moved, so a call after a crash finds all names again, those that
have been moved as well. A task looks at both places before it moves a name, so it may be run again, or
twice at once. The files are reached through pyarrow, whose file systems the tasks open by the addresses' scheme and host.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import bare_path, squeeze
from lakekeep.operators.quarantine import checked_day
from lakekeep.session import hadoop_path, pinned
from lakekeep.sources.files import scan_files

# States of a name. A conflict has a file in both places, a missing one in neither; both are left alone.
MOVED, DONE, OPEN, CONFLICT, MISSING, FAILED = "moved", "done", "open", "conflict", "missing", "failed"
PLAN_SCHEMA = "source string, goal string"
# Names of one task, about.
TASK_NAMES = 2_000


def plan_trash(files: DataFrame, trash_root: str, day: str) -> DataFrame:
    """(source, goal) of files (`location` as `scan_files` tells it) on their way to the dated trash."""
    goal = F.concat(F.lit(f"{trash_root.rstrip('/')}/{checked_day(day)}"), squeeze(bare_path("location")))
    return files.select(F.col("location").alias("source"), goal.alias("goal"))


def stored_plan(spark: SparkSession, plan: DataFrame, at: str) -> DataFrame:
    """The plan that is stored at `at`; the given one is stored if there is none."""
    fs, done = hadoop_path(spark, f"{at.rstrip('/')}/_SUCCESS")
    if not fs.exists(done):
        plan.select("source", "goal").write.mode("overwrite").parquet(at)
    return spark.read.schema(PLAN_SCHEMA).parquet(at)


def _states(plan: DataFrame, move: bool) -> DataFrame:
    """(source, goal, state) of every name of a plan, moved where `move` says so.

    Nothing of this package is needed by the tasks.
    """
    words = (MOVED, DONE, OPEN, CONFLICT, MISSING, FAILED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import pyarrow
        from pyarrow import fs

        moved, done, still, conflict, missing, failed = words
        systems: dict[str, tuple] = {}
        made: set[tuple] = set()

        def opened(address: str) -> tuple:
            """File system, its key, and the path in it."""
            scheme, host, path = re.fullmatch(r"(?s)(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/]*))?(/.*)", address).groups()
            key = "" if scheme in (None, "file") else f"{scheme}://{host or ''}/"
            if key not in systems:
                systems[key] = fs.FileSystem.from_uri(key) if key else (fs.LocalFileSystem(), "")
            system, root = systems[key]
            return system, key, root.rstrip("/") + path

        def state_of(source: str, goal: str) -> str:
            system, key, at = opened(source)
            other, other_key, to = opened(goal)
            if key != other_key:
                return failed
            here, there = (i.type != fs.FileType.NotFound for i in system.get_file_info([at, to]))
            if there:
                return conflict if here else done
            if not here:
                return missing
            if not move:
                return still
            folder = key, to.rsplit("/", 1)[0]
            try:
                if folder not in made:
                    system.create_dir(folder[1], recursive=True)
                    made.add(folder)
                system.move(at, to)
            except OSError:
                # Another attempt may have been faster.
                here, there = (i.type != fs.FileType.NotFound for i in system.get_file_info([at, to]))
                return done if there and not here else failed
            return moved

        for batch in batches:
            sources, goals = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            states = pyarrow.array([state_of(s, g) for s, g in zip(sources, goals)], pyarrow.string())
            yield pyarrow.RecordBatch.from_arrays([batch.column(0), batch.column(1), states], names=["source", "goal", "state"])

    return plan.select("source", "goal").mapInArrow(run, f"{PLAN_SCHEMA}, state string")


def move_files(spark: SparkSession, plan: DataFrame, at: str) -> DataFrame:
    """Carry out a plan, stored at `at`, by tasks; returns (source, goal, state) as every name was met, stored.

    Called again with the same `at` it ends what was begun, whatever `plan` says by then.
    """
    held = stored_plan(spark, plan, at)
    tasks = max(1, -(-held.count() // TASK_NAMES))
    # Names of one folder are dealt out too; names, not rows, tell where they go, so a task run again has the same.
    dealt = held.repartition(tasks, "source")
    return pinned(_states(dealt, True), "moved")


def check_moves(spark: SparkSession, at: str) -> DataFrame:
    """(source, goal, state) of a stored plan as things are: done, open, conflict or missing. Nothing is moved."""
    return _states(spark.read.schema(PLAN_SCHEMA).parquet(at), False)


def trash_files(spark: SparkSession, glob: str | list[str], trash_root: str, day: str, at: str) -> DataFrame:
    """Move every single file that a glob names, or that lies below it, to the dated trash; the plan is stored at `at`.

    For very many files of which others stay; whole folders are moved by one renaming each (`move_matching`).
    """
    fs, done = hadoop_path(spark, f"{at.rstrip('/')}/_SUCCESS")
    files = spark.createDataFrame([], "location string") if fs.exists(done) else scan_files(spark, glob, recursive=True)
    return move_files(spark, plan_trash(files, trash_root, day), at)
