"""Partition registrations of catalog tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import partition_value, partition_values
from lakekeep.session import pinned
from lakekeep.sources.files import NULL_PARTITION, partition_columns, quoted

# Partitions named in one catalog statement.
DDL_BATCH = 100


class Registered(NamedTuple):
    """How many partitions were added, and those (values.., locations) left out since they lie in several places."""

    added: int
    conflicts: DataFrame


def missing_partitions(found: DataFrame, registered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct partition values that are found but not yet registered; null is a value.

    Both sides are folded to distinct values before the join, however many rows a partition has. Values are
    compared in the type that `registered` has them in, so folders `h=05` and `h=5` are one integer.
    """
    typed = found.select(*[F.col(n).cast(registered.schema[n].dataType).alias(n) for n in names]).distinct()
    return typed.join(_known(registered, names), _same(names), "left_anti")


def _known(registered: DataFrame, names: Sequence[str]) -> DataFrame:
    return registered.select(*[F.col(n).alias(f"_known_{n}") for n in names]).distinct()


def _same(names: Sequence[str]) -> Column:
    hit = F.lit(True)
    for n in names:
        hit = hit & F.col(n).eqNullSafe(F.col(f"_known_{n}"))
    return hit


def unescaped(value: Column) -> Column:
    """A partition value as it was before it became folder text; null for the null partition."""
    plain = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    return F.when(value != NULL_PARTITION, plain)


def found_partitions(inv: DataFrame, names: Sequence[str]) -> DataFrame:
    """(names.., location): the partition folders of an inventory.

    A folder ends at the level of the last partition column, wherever below it the file lies, and keeps its file
    system where the inventory has a `location`.
    """
    where = "location" if "location" in inv.columns else "path"
    last = re.escape(names[-1])
    folder = F.regexp_extract(where, f"^(.*?/{last}=[^/]*)/", 1)
    folders = inv.select(folder.alias("location")).where("location <> ''").distinct()
    raw = [partition_value("location", n).alias(n) for n in names]
    held = folders.select(*raw, "location").where(" and ".join(f"`{n}` is not null" for n in names))
    return held.select(*[unescaped(F.col(n)).alias(n) for n in names], "location")


def registered_partitions(spark: SparkSession, table: str) -> DataFrame:
    """(columns..) of the partitions the catalog knows, in the columns' types."""
    names = partition_columns(spark, table)
    schema = spark.table(table).schema
    listed = spark.sql(f"show partitions {table}").select(partition_values("partition").alias("v"))
    return listed.select(*[unescaped(F.col("v")[i]).cast(schema[n].dataType).alias(n) for i, n in enumerate(names)])


def require_external(spark: SparkSession, table: str) -> None:
    """Refuse managed tables: dropping their partitions would delete files."""
    if spark.catalog.getTable(table).tableType != "EXTERNAL":
        raise ValueError(f"{table} is not an external table")


def _spec(names: Sequence[str], values: Sequence[str | None]) -> str:
    return ", ".join(f"`{n}`={quoted(v)}" for n, v in zip(names, values))


def _batches(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def register_partitions(spark: SparkSession, table: str, found: DataFrame) -> Registered:
    """Register the found partitions (columns.., location) the catalog lacks.

    Known ones are taken out first: adding one again could move its location.
    A partition that was found in several places is left out and reported. The
    statements name a batch of partitions each, read one by one from the
    result; no rows of the partitions themselves reach the driver.
    """
    require_external(spark, table)
    names = partition_columns(spark, table)
    known = registered_partitions(spark, table)
    typed = found.select(*[F.col(n).cast(known.schema[n].dataType).alias(n) for n in names], "location")
    fresh = typed.join(_known(known, names), _same(names), "left_anti").groupBy(*names).agg(
        F.min("location").alias("location"), F.max("location").alias("_last")
    )
    fresh = pinned(fresh, "partitions")
    added = 0
    single = fresh.where("location = _last").select(*[F.col(n).cast("string").alias(n) for n in names], "location")
    for batch in _batches(single.toLocalIterator(), DDL_BATCH):
        clauses = " ".join(
            f"partition ({_spec(names, [row[n] for n in names])}) location {quoted(row['location'])}" for row in batch
        )
        spark.sql(f"alter table {table} add {clauses}")
        added += len(batch)
    several = fresh.where("location <> _last").select(*names, F.array("location", "_last").alias("locations"))
    return Registered(added, several)


def unregister_partition(spark: SparkSession, table: str, values: Sequence[str]) -> None:
    """Forget one partition; its files stay."""
    require_external(spark, table)
    names = partition_columns(spark, table)
    spark.sql(f"alter table {table} drop if exists partition ({_spec(names, values)})")
