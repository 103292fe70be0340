"""Landed metric snapshots: JSON payloads per (ts, namespace, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = "ts timestamp, namespace string, node string, payload string"
BEANS_SCHEMA = "struct<beans:array<map<string,string>>>"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path)


def stream_snapshots(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def broken_snapshots(snapshots: DataFrame) -> DataFrame:
    """(ts, namespace, node, payload, reason) of the snapshots that give no bean: no JSON, or JSON without a list of beans."""
    told = snapshots.withColumn("_parsed", F.from_json("payload", BEANS_SCHEMA))
    reason = (
        F.when(F.col("payload").isNull(), "missing")
        .when(F.try_parse_json("payload").isNull(), "json")
        .when(F.coalesce(F.size("_parsed.beans"), F.lit(-1)) < 0, "beans")
    )
    held = told.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return held.select("ts", "namespace", "node", "payload", "reason")


def explode_beans(snapshots: DataFrame) -> DataFrame:
    """(ts, namespace, node, name, bean): one row per bean; `bean` maps field to text.

    Snapshots that cannot be read give no row; `broken_snapshots` tells of them.
    """
    parsed = snapshots.select(
        "ts", "namespace", "node", F.explode(F.from_json("payload", BEANS_SCHEMA)["beans"]).alias("bean")
    )
    return parsed.withColumn("name", F.col("bean")["name"])
