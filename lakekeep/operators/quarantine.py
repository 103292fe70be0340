"""Move rows, files, partitions to a dated trash, and purge a day of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakekeep.functions.paths import glob_match, trash_path
from lakekeep.operators.partitions import require_external, unregister_partition
from lakekeep.session import hadoop_path, work_path
from lakekeep.sources.files import partition_location


def checked_day(day: str) -> str:
    if not re.fullmatch(r"\d{8}", day):
        raise ValueError(f"not a trash day: {day!r}")
    return day


def quarantine(df: DataFrame, predicate: Column, day: str) -> tuple[DataFrame, DataFrame]:
    """(kept, trashed): every row lands in exactly one of them.

    A row for which the predicate is unknown is kept. Trashed rows carry the
    day in `trash_day`, ready for `partitionBy('trash_day')`.
    """
    hit = F.coalesce(predicate, F.lit(False))
    stamped = df.where(hit).withColumn("trash_day", F.lit(checked_day(day)))
    return df.where(~hit), stamped


def quarantine_files(inv: DataFrame, pattern: str, trash_root: str, day: str) -> DataFrame:
    """(path, trash_path) of everything the glob names."""
    hits = inv.where(glob_match("path", pattern))
    return hits.select("path", trash_path(trash_root, checked_day(day), "path").alias("trash_path"))


def write_trash(trashed: DataFrame, trash_root: str, name: str) -> None:
    """Write quarantined rows below `<trash root>/<day>/<name>`, the layout of everything in the trash."""
    spark = trashed.sparkSession
    held = work_path(spark, "trashed")
    # The rows are made once, parted by day; each day then reads its own part.
    trashed.write.partitionBy("trash_day").parquet(held)
    stored = spark.read.schema(trashed.schema).parquet(held)
    for day in trash_days(stored):
        rows = stored.where(F.col("trash_day") == day).drop("trash_day")
        rows.write.mode("append").parquet(f"{trash_root.rstrip('/')}/{day}/{name.strip('/')}")


def trash_days(trashed: DataFrame) -> list[str]:
    """The days that quarantined rows carry: one for each quarantine that they come from."""
    return sorted(checked_day(r["trash_day"]) for r in trashed.select("trash_day").distinct().collect())


def read_trash(spark: SparkSession, trash_root: str, name: str, schema: StructType) -> DataFrame:
    """Rows of one name over all days, with the day in `trash_day`."""
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{8})/" + re.escape(name.strip("/")) + "/", 1)
    path = f"{trash_root.rstrip('/')}/*/{name.strip('/')}"
    return spark.read.schema(schema).parquet(path).select("*", day.alias("trash_day"))


def purge(trash: DataFrame, day: str) -> DataFrame:
    """The trash without one day; rows that tell no day stay."""
    return trash.where(~F.col("trash_day").eqNullSafe(checked_day(day)))


def purge_trash(spark: SparkSession, trash_root: str, day: str) -> bool:
    """Delete one day below a trash root; true when there was something to delete."""
    checked_day(day)
    if not trash_root.strip("/ ") or trash_root.rstrip("/").endswith(":"):
        raise ValueError(f"unsafe trash root: {trash_root!r}")
    fs, at = hadoop_path(spark, f"{trash_root.rstrip('/')}/{day}")
    return bool(fs.delete(at, True))


def trash_goal(bare: str, trash_root: str, day: str) -> str:
    if bare.rstrip("/").count("/") < 2:
        raise ValueError(f"too close to the root: {bare!r}")
    return f"{trash_root.rstrip('/')}/{checked_day(day)}{bare.rstrip('/')}"


def move_tree(spark: SparkSession, path: str, trash_root: str, day: str) -> str:
    """Rename one file or folder into the dated trash under its absolute path; returns the new place.

    May be called again after a crash: what lies in the trash already, and nowhere else, is left there.
    """
    fs, at = hadoop_path(spark, path)
    goal = trash_goal(at.toUri().getPath(), trash_root, day)
    _, to = hadoop_path(spark, goal)
    if fs.exists(to):
        if fs.exists(at) and not (fs.getFileStatus(at).isDirectory() and not len(fs.listStatus(at))):
            raise FileExistsError(goal)
        # A catalog may have put an empty folder in the old place.
        fs.delete(at, True)
        return goal
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise RuntimeError(f"could not move {path} to {goal}")
    return goal


def move_matching(spark: SparkSession, glob: str, trash_root: str, day: str) -> list[str]:
    """Rename everything that a file-system glob names into the dated trash; returns the new places.

    A renaming is one call to the file system, whatever lies below the name.
    """
    fs, at = hadoop_path(spark, glob)
    return [move_tree(spark, hit.getPath().toString(), trash_root, day) for hit in fs.globStatus(at) or []]


def quarantine_partition(spark: SparkSession, table: str, values: list[str], trash_root: str, day: str) -> str | None:
    """Move the folder of one partition to the trash, then unregister it; returns the new place.

    The files go, whatever their format, so a later registration does not find
    the partition again. Called again after a crash it ends what was begun.
    Works on external tables only.
    """
    require_external(spark, table)
    location = partition_location(spark, table, values)
    goal = move_tree(spark, location, trash_root, day) if location else None
    unregister_partition(spark, table, values)
    return goal
