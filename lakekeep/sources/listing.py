"""Listing and change text as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.operators.diff import ADD

LISTING_FIELDS = ("permission", "replication", "owner", "grp", "size", "date", "time", "path")


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their reading position: file, then byte offset of the split, then row."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("value").alias("raw"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
    )


def with_fields(lines: DataFrame) -> DataFrame:
    """Adds the array `fields` of the blank-separated fields of `raw`.

    Blanks at the end do not count, a leading one does. Runs of blanks are made
    one first, so that the split needs no regular expression. The explode of a
    single element keeps the optimizer from repeating the work in each filter
    that it would otherwise push below.
    """
    fields = F.split(F.rtrim(F.regexp_replace("raw", r"\s+", " ")), " ")
    return lines.select("*", F.explode(F.array(fields)).alias("fields"))


def split_valid(lines: DataFrame, counts: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Part lines by their number of fields; adds the array column `fields`."""
    fielded = with_fields(lines)
    good = F.size("fields").isin(*counts)
    return fielded.where(good), fielded.where(~good).drop("fields")


def _listing_columns(first: Column | int) -> list[Column]:
    """Typed listing columns from `fields`, the permission being at index `first`."""

    def at(i: int) -> Column:
        return F.get(F.col("fields"), (F.lit(first) if isinstance(first, int) else first) + i)

    stamp = F.concat_ws(" ", at(5), at(6))
    return [
        at(0).alias("permission"),
        at(1).alias("replication"),
        at(2).alias("owner"),
        at(3).alias("grp"),
        at(4).try_cast("bigint").alias("size"),
        stamp.try_cast("timestamp_ntz").alias("mtime"),
        at(7).alias("path"),
    ]


def parse_listing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) of lines with column `raw`.

    Valid lines have eight fields with a readable size and time. All others
    stay whole in the second table, with the reason.
    """
    kept = [c for c in lines.columns if c != "raw"]
    good, bad = split_valid(lines, [len(LISTING_FIELDS)])
    typed = good.select(*_listing_columns(0), "raw", *kept)
    readable = F.col("size").isNotNull() & F.col("mtime").isNotNull()
    unreadable = typed.where(~readable).select("raw", *kept, F.lit("value").alias("reason"))
    invalid = bad.select("raw", *kept, F.lit("arity").alias("reason")).unionByName(unreadable)
    return typed.where(readable), invalid


def read_listing(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_listing(text_lines(spark, path))


def parse_changes(lines: DataFrame) -> DataFrame:
    """Change lines of eight fields (op ADD) or nine (op first, upper-cased).

    Lines of any other arity are kept with a null op.
    """
    kept = [c for c in lines.columns if c != "raw"]
    fielded = with_fields(lines)
    arity = F.size("fields")
    plain = len(LISTING_FIELDS)
    op = F.when(arity == plain, ADD).when(
        arity == plain + 1, F.upper(F.get(F.col("fields"), F.lit(0)))
    )
    first = F.when(arity == plain, 0).when(arity == plain + 1, 1)
    return fielded.select(op.alias("op"), *_listing_columns(first), "raw", *kept)


def read_changes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_changes(text_lines(spark, path))
