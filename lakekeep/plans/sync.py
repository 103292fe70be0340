"""Full and incremental synchronisation of a target with a source, in one pass or chunk by chunk."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakekeep.operators.diff import ADD, exclude_transient, snapshot_diff
from lakekeep.operators.split import split_work
from lakekeep.plans.actions import COUNTERS, counter_columns
from lakekeep.plans.apply import apply_changes, decide, failures_in, fold_changes, lined, settle
from lakekeep.session import pinned
from lakekeep.sources.ledger import Ledger
from lakekeep.sources.sinks import FAILURE_SCHEMA, write_chunks, write_failures, write_parquet_tier

# Default numbers of work chunks.
FULL_CHUNKS = 50
DIFF_CHUNKS = 25
# States of a chunk. A failed chunk has changes that could not be made; the next call tries it again.
OPEN, DONE, FAILED = "open", "done", "failed"
CARRIED = ("chunk", "raw")


class Synced(NamedTuple):
    changes: DataFrame
    snapshot: DataFrame
    failures: DataFrame
    # The job counters by name, over the last change of each key; told by the job that decided them.
    counters: dict[str, int]


class Progress(NamedTuple):
    """Chunks worked off by a call, the states of all, and the result once no chunk is open."""

    worked: list[int]
    states: dict[int, str]
    synced: Synced | None


def _lined(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "raw" in changes.columns:
        return changes
    return changes.withColumn("raw", F.concat_ws(" ", "op", *keys))


def _listed(changes: DataFrame, keys: Sequence[str], stored: bool) -> DataFrame:
    """The change list with its lines as a table that may be read several times."""
    told = _lined(changes, keys)
    return told if stored else pinned(told, "changes")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "pos"])


def run_changes(
    spark: SparkSession, target: DataFrame, source: DataFrame, changes: DataFrame, out: str, chunks: int = DIFF_CHUNKS,
    seed: int = 7, keys: Sequence[str] = ("path",), tier: str = "WARM", tree: bool = False, stored: bool = False,
) -> Synced:
    """Shuffle, split and apply a change list; the steps that both kinds of synchronisation share.

    `stored` says that the change list is a stored table already. With `tree` the DELETE of a folder takes all that lies below it on the target, and a file does not replace a folder.
    """
    shuffled = split_work(_listed(changes, keys, stored), chunks, seed)
    write_chunks(shuffled, f"{out}/changes")
    # Read with their schemas: there may be no change, and then no file.
    landed = spark.read.schema(shuffled.schema).parquet(f"{out}/changes")
    counted = Observation("sync")
    done = apply_changes(_plain(target), source, landed, keys, tree=tree, carry=CARRIED, observation=counted)
    write_parquet_tier(done.snapshot, f"{out}/snapshot", tier)
    write_failures(done.failures, f"{out}/failures")
    snapshot = spark.read.schema(done.snapshot.schema).parquet(f"{out}/snapshot")
    failures = spark.read.schema(FAILURE_SCHEMA).parquet(f"{out}/failures")
    return Synced(landed, snapshot, failures, counted.get)


def _planned(
    spark: SparkSession, changes: DataFrame, out: str, chunks: int, seed: int, keys: Sequence[str], ledger: Ledger, after: int, stored: bool
) -> dict:
    """Split the change list into chunks of last changes, stored at `out`; returns the first state."""
    shuffled = split_work(_listed(changes, keys, stored), chunks, seed)
    write_chunks(shuffled, f"{out}/changes", "overwrite")
    landed = spark.read.schema(shuffled.schema).parquet(f"{out}/changes")
    told = fold_changes(landed, keys, carry=CARRIED)
    told.hint("rebalance", "chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{out}/told")
    # A row for each chunk.
    sizes = spark.read.schema(told.schema).parquet(f"{out}/told").groupBy("chunk").count().collect()
    state = {
        "columns": landed.schema.json(), "told": told.schema.json(),
        "chunks": {str(r["chunk"]): {"state": OPEN, "changes": r["count"], "attempts": 0} for r in sizes},
    }
    ledger.commit(state, after)
    return state


def run_chunks(
    spark: SparkSession, target: DataFrame, source: DataFrame, changes: DataFrame | Callable[[], DataFrame], out: str,
    chunks: int = DIFF_CHUNKS, seed: int = 7, keys: Sequence[str] = ("path",), tier: str = "WARM", tree: bool = False,
    most: int | None = None, wave: int | None = None, stored: bool = False,
) -> Progress:
    """As `run_changes`, but a run that stopped goes on where it was when it is called again with the same arguments.

    The ledger below `out` has the state of each chunk. The first call stores the change list in chunks;
    it is not looked at again. A wave (`wave` chunks, by default all that are to do) is decided by one
    job, which replaces these chunks' folders as a whole, and then entered in the ledger: what a stopped wave
    left behind is overwritten. Open and failed chunks are worked off, done ones are not touched.
    `most` limits the chunks of one call. When none is open any more, the snapshot and the failures are written from all decisions.
    """
    ledger = Ledger(spark, f"{out}/ledger")
    number, state = ledger.last()
    if state is None:
        state = _planned(spark, changes() if callable(changes) else changes, out, chunks, seed, keys, ledger, number, stored)
        number += 1
    target = _plain(target)
    told = spark.read.schema(StructType.fromJson(json.loads(state["told"]))).parquet(f"{out}/told")
    landed = spark.read.schema(StructType.fromJson(json.loads(state["columns"]))).parquet(f"{out}/changes")
    decided = decide(target, source, told, keys, tree)
    schema = decided.schema
    todo = sorted(int(c) for c, s in state["chunks"].items() if s["state"] != DONE)[:most]
    size = max(1, wave or len(todo))
    for start in range(0, len(todo), size):
        part = todo[start : start + size]
        rows = decide(target, source, told.where(F.col("chunk").isin(part)), keys, tree)
        writer = rows.hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("chunk").parquet(f"{out}/decided")
        stored = spark.read.schema(schema).parquet(f"{out}/decided").where(F.col("chunk").isin(part))
        # A row for each chunk of the wave.
        for r in lined(stored).groupBy("chunk").agg(*counter_columns()).collect():
            chunk = state["chunks"][str(r["chunk"])]
            counted = {n: r[n] for n in COUNTERS}
            chunk |= {"counters": counted, "state": FAILED if r["fail"] else DONE, "attempts": chunk["attempts"] + 1}
        number = ledger.commit(state, number)
    states = {int(c): s["state"] for c, s in sorted(state["chunks"].items(), key=lambda x: int(x[0]))}
    if OPEN in states.values():
        return Progress(todo, states, None)
    if todo or not state.get("written"):
        # A list without a change has no decisions, hence no folder.
        stored = spark.read.schema(schema).parquet(f"{out}/decided") if states else decided
        settled = settle(target, stored, keys, tree)
        write_parquet_tier(settled, f"{out}/snapshot", tier, "overwrite")
        write_failures(failures_in(stored, keys, CARRIED), f"{out}/failures", "overwrite")
        ledger.commit(state | {"written": True}, number)
    snapshot = spark.read.schema(target.schema).parquet(f"{out}/snapshot")
    failures = spark.read.schema(FAILURE_SCHEMA).parquet(f"{out}/failures")
    counts = {n: sum(c["counters"][n] for c in state["chunks"].values()) for n in COUNTERS}
    return Progress(todo, states, Synced(landed, snapshot, failures, counts))


def sync_diff(
    spark: SparkSession, old: DataFrame, new: DataFrame, out: str, chunks: int = DIFF_CHUNKS,
    seed: int = 7, ignore_time: bool = False, keys: Sequence[str] = ("path",), tier: str = "WARM",
    stored: bool = False, tree: bool = False, target: DataFrame | None = None,
) -> Synced:
    """Diff, shuffle, split, apply. Everything is written below `out`, nothing is overwritten.

    Failures are rows (chunk, raw, reason), `raw` being the change's line.

    `old` is the target's listing and `new` the source's. Transient rows are not compared: those of
    the source are not taken, those of the target stay, unless `tree` says that rows are files and folders and a folder above
    them is deleted. `target` is what lies on the target, where that is more than its listing tells; such rows
    stay or go as transient ones do.

    The change list is written once and read back, so the steps after it start from files. So are
    the listings, lest each pass parse their text again; `stored` says that
    they are columnar tables already.
    """
    if not stored:
        old, new = pinned(old, "old"), pinned(new, "new")
    changes = snapshot_diff(old, new, keys, ignore_time=ignore_time)
    return run_changes(spark, old if target is None else target, new, changes, out, chunks, seed, keys, tier, tree)


def sync_resumable(
    spark: SparkSession, old: DataFrame, new: DataFrame, out: str, chunks: int = DIFF_CHUNKS,
    seed: int = 7, ignore_time: bool = False, keys: Sequence[str] = ("path",), tier: str = "WARM",
    tree: bool = False, target: DataFrame | None = None, most: int | None = None, wave: int | None = None,
) -> Progress:
    """`sync_diff` of stored listings that may be stopped and called again; see `run_chunks`.

    The diff is made by the first call alone.
    """
    whole = old if target is None else target
    return run_chunks(
        spark, whole, new, lambda: snapshot_diff(old, new, keys, ignore_time=ignore_time), out, chunks, seed, keys, tier, tree, most, wave,
    )


def sync_full(
    spark: SparkSession, source: DataFrame, out: str, chunks: int = FULL_CHUNKS,
    seed: int = 7, keys: Sequence[str] = ("path",), tier: str = "WARM", stored: bool = False,
) -> Synced:
    """Every source row as an ADD on an empty target."""
    kept = exclude_transient(source)
    if not stored:
        kept = pinned(kept, "new")
    changes = kept.withColumn("op", F.lit(ADD))
    empty = kept.where(F.lit(False))
    return run_changes(spark, empty, kept, changes, out, chunks, seed, keys, tier, stored=True)
