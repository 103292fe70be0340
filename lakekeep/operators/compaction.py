"""Pack, recompress and count text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import parent
from lakekeep.operators.quarantine import move_tree
from lakekeep.operators.running import running_before
from lakekeep.operators.split import whole
from lakekeep.session import hadoop_path
from lakekeep.sources.files import line_digest, read_text_tree
from lakekeep.sources.sinks import write_text_tier

# What opening one more file counts for when files are packed into tasks.
OPEN_BYTES = 1 << 20


def line_count(lines: DataFrame) -> DataFrame:
    """One row (lines); zero for empty input."""
    return lines.agg(F.count(F.lit(1)).alias("lines"))


def plan_compaction(inv: DataFrame, target_bytes: int) -> DataFrame:
    """Adds `dir` and `bin`: neighbours in path order share an output file.

    A file goes to the bin in which its first byte lies, when the files of a
    folder are laid end to end and cut every `target_bytes`.
    """
    placed = running_before(inv.withColumn("dir", parent("path")), ["dir"], ["path"], "size", "before")
    return placed.withColumn("bin", whole(F.col("before"), F.lit(target_bytes))).drop("before")


def content_digest(lines: DataFrame) -> DataFrame:
    return lines.agg(*line_digest())


@dataclass(frozen=True)
class CompactionReport:
    lines: int
    target: str
    tier: str


def packed_scan(spark: SparkSession, src: str | list[str], target_bytes: int, line_sep: str | None) -> DataFrame:
    """A text scan whose tasks each cover about `target_bytes` of input files.

    Opening a file counts as OPEN_BYTES, so that very many tiny or empty files
    do not meet in one task. The sizes are set on a session of its own, so the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(min(OPEN_BYTES, max(1, target_bytes // 16))))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return read_text_tree(own, src, line_sep)


def compact_text(
    spark: SparkSession, src: str, dst: str, tier: str,
    target_bytes: int = 1 << 30, line_sep: str | None = None,
) -> CompactionReport:
    """Rewrite all text below `src` into few files at `dst` in the tier's codec.

    `src` may be a glob. Map-only: one output file per packed input share. The
    source is left alone and read once; its lines are digested on their way to
    the writer. The result is read back and compared before the call returns,
    so a caller may replace the source afterwards (`swap_compacted`).
    """
    seen = Observation("compaction")
    lines = packed_scan(spark, src, target_bytes, line_sep).observe(seen, *line_digest())
    write_text_tier(lines, dst, tier)
    before = seen.get
    after = content_digest(read_text_tree(spark, dst, line_sep)).first().asDict()
    if before != after:
        raise RuntimeError(f"compaction changed the lines of {src}; {dst} must not be used")
    return CompactionReport(after["lines"], dst, tier.upper())


def planned_files(inv: DataFrame, target_bytes: int) -> DataFrame:
    """(dir, files_before, files_after, bytes): what a compaction by `plan_compaction` leaves of every folder."""
    plan = plan_compaction(inv, target_bytes)
    return plan.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files_before"), F.countDistinct("bin").alias("files_after"),
        F.sum("size").cast("bigint").alias("bytes"),
    )


def swap_compacted(
    spark: SparkSession, src: str, compacted: str, out: str, prefix: str, trash_root: str, day: str
) -> list[str]:
    """End a checked compaction: originals to the dated trash, new files into `out` under a prefix.

    Returns the new files. Called again after a crash it ends what was begun: what
    lies in the trash stays there, and files already moved are left.
    """
    fs, at = hadoop_path(spark, src)
    if fs.exists(at):
        move_tree(spark, src, trash_root, day)
    _, goal = hadoop_path(spark, out)
    fs.mkdirs(goal)
    _, made = hadoop_path(spark, compacted)
    for status in fs.listStatus(made) if fs.exists(made) else []:
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            _, to = hadoop_path(spark, f"{out.rstrip('/')}/{prefix}{name}")
            if not fs.rename(status.getPath(), to):
                raise RuntimeError(f"could not move {name} to {out}")
    return sorted(s.getPath().getName() for s in fs.listStatus(goal) if s.getPath().getName().startswith(prefix))
