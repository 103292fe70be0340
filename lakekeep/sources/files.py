"""Inventories of files and partitions, and recursive text scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import bare_path, squeeze

# Fixed value: the folder text of a partition whose value is null.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def scan_files(spark: SparkSession, glob: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, location, size, mtime) of the files a glob names; no file content is read.

    `location` is the full address, `path` the part of it that does not name a file system.

    The file index leaves out names that start with `_` or `.`.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    found = reader.load(glob)
    bare = bare_path("path")
    return found.select(
        squeeze(bare).alias("path"),
        F.col("path").alias("location"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.lit(True).alias("is_file"),
    )


def file_digests(lines: DataFrame) -> DataFrame:
    """(path, digest) of every file of a text scan: count and sums of its lines' hashes.

    A file's lines are folded per task, so a large file needs no task of its own.
    """
    at = bare_path(F.col("_metadata.file_path"))
    held = lines.select(squeeze(at).alias("path"), "value").groupBy("path").agg(*line_digest())
    return held.select("path", F.concat_ws(":", *[c for c in held.columns if c != "path"]).alias("digest"))


def line_digest() -> list[Column]:
    """Aggregates telling two line multisets apart, whatever their order.

    Count, and sums of two halves of the line's md5, added as decimals so they
    cannot overflow.
    """
    digest = F.md5("value")
    halves = [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 17)]
    return [
        F.count(F.lit(1)).alias("lines"),
        *[F.sum(h).cast("decimal(38,0)").alias(f"digest_{i}") for i, h in enumerate(halves)],
    ]


def read_text_tree(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Lines of all text files below a folder, compressed or not."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def partition_filter(spark: SparkSession, table: str, values: list[str]) -> Column:
    names = partition_columns(spark, table)
    if len(names) != len(values):
        raise ValueError(f"{table} has {len(names)} partition columns, got {len(values)} values")
    hit = F.lit(True)
    for name, value in zip(names, values):
        is_null = value == NULL_PARTITION
        hit = hit & (F.col(name).isNull() if is_null else F.col(name) == F.lit(value))
    return hit


def partition_location(spark: SparkSession, table: str, values: list[str]) -> str | None:
    """Where the catalog says that a partition lies; None when it has no such partition."""
    names = partition_columns(spark, table)
    if len(names) != len(values):
        raise ValueError(f"{table} has {len(names)} partition columns, got {len(values)} values")
    spec = ", ".join(f"`{n}`={quoted(v)}" for n, v in zip(names, values))
    try:
        told = spark.sql(f"describe formatted {table} partition ({spec})").where("col_name = 'Location'").first()
    except AnalysisException as error:
        if "PARTITION" in (error.getCondition() or ""):
            return None
        raise
    return told["data_type"] if told else None


def partition_locations(spark: SparkSession, table: str) -> DataFrame:
    """(columns.., location) of all partitions of a table, as text, from one question to the catalog; null is the null partition.

    The catalog answers the driver, with a row for each partition.
    """
    names = partition_columns(spark, table)
    session = spark._jsparkSession.sessionState()
    found = session.catalog().listPartitions(session.sqlParser().parseTableIdentifier(table), getattr(spark._jvm.scala, "None$").__getattr__("MODULE$"))
    rows = []
    for k in range(found.size()):
        part = found.apply(k)
        values = [part.spec().apply(n) for n in names]
        where = part.storage().locationUri()
        rows.append((*[None if v == NULL_PARTITION else v for v in values], where.get().toString() if where.isDefined() else None))
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", location string")


def quoted(text: str | None) -> str:
    """A partition value in a statement; the null partition is null."""
    if text is None or text == NULL_PARTITION:
        return "null"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_partition(spark: SparkSession, table: str, values: list[str]) -> DataFrame:
    """Rows of one partition, with the file each came from and its size."""
    return spark.table(table).where(partition_filter(spark, table, values)).select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
    )
