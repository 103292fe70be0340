"""Writers: change text, work chunks, failures, tiered text, metric points."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.operators.diff import change_lines
from lakekeep.session import hadoop_path

# The tiers' text codecs among those Spark's text writer offers.
TEXT_CODECS = {"HOT": "lz4", "WARM": "gzip", "COLD": "bzip2"}
PARQUET_CODECS = {"HOT": "lz4_raw", "WARM": "zstd", "COLD": "gzip"}
NO_MARKER = "mapreduce.fileoutputcommitter.marksuccessfuljobs"

FAILURE_SCHEMA = "chunk int, raw string, reason string"


def codec_of(tier: str, codecs: dict[str, str]) -> str:
    try:
        return codecs[tier.upper()]
    except KeyError:
        raise ValueError(f"unknown tier: {tier}") from None


def write_changes(changes: DataFrame, path: str) -> None:
    change_lines(changes).write.text(path)


def write_chunks(chunked: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per work chunk for the rows of `split_work`, which deals them to tasks by their index."""
    chunked.write.mode(mode).partitionBy("chunk").parquet(path)


def failures_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("reason").isNotNull())


def write_failures(outcomes: DataFrame, path: str, mode: str = "error") -> None:
    """Failure rows sorted by chunk and line over all output files.

    A range partitioning splits a chunk that holds most of the failures.
    """
    rows = failures_of(outcomes).select("chunk", "raw", "reason")
    rows.repartitionByRange("chunk", "raw").sortWithinPartitions("chunk", "raw").write.mode(mode).parquet(path)


def write_text_tier(lines: DataFrame, path: str, tier: str) -> None:
    """Text in the tier's codec, without a success marker."""
    codec = codec_of(tier, TEXT_CODECS)
    lines.select("value").write.option("compression", codec).option(NO_MARKER, "false").text(path)


def write_parquet_tier(rows: DataFrame, path: str, tier: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("compression", codec_of(tier, PARQUET_CODECS)).parquet(path)


def with_shards(points: DataFrame) -> DataFrame:
    """Adds the shard column of the metric store, the day."""
    return points.withColumn("date", F.date_format("ts", "yyyy-MM-dd"))


def write_metrics(points: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the store, one folder a day, ordered by time within a file.

    Rebalancing gives few files per day and splits large days.
    """
    shards = with_shards(points).hint("rebalance", "date").sortWithinPartitions("date", "ts")
    shards.write.mode(mode).partitionBy("date").parquet(path)


def expire_metrics(spark: SparkSession, path: str, as_of: str, days: int) -> list[str]:
    """Delete the day folders of the store that lie wholly before the kept time; returns their days."""
    first = datetime.fromisoformat(as_of) - timedelta(days=int(days))
    fs, at = hadoop_path(spark, path)
    gone = []
    for status in fs.listStatus(at):
        day = re.fullmatch(r"date=(\d{4}-\d\d-\d\d)", status.getPath().getName())
        if day and datetime.fromisoformat(day[1]) + timedelta(days=1) <= first:
            fs.delete(status.getPath(), True)
            gone.append(day[1])
    return sorted(gone)
