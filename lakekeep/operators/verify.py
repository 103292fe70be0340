"""Compare the content of two trees path by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeep.functions.paths import is_trash
from lakekeep.operators.diff import ADD, UPDATE

# Verification results.
MATCH, CONTENT, KIND, UNKNOWN = "MATCH", "CONTENT", "KIND", "UNKNOWN"
NO_SOURCE, NO_TARGET, NO_BOTH = "NO_SOURCE", "NO_TARGET", "NO_BOTH"


def exclude_trash(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(~is_trash(path))


def _side(df: DataFrame, side: str) -> DataFrame:
    flag = F.col("is_file") if "is_file" in df.columns else F.lit(True)
    return df.select(
        "path",
        flag.alias("file"),
        F.when(flag, F.col("digest")).alias("digest"),
        F.lit(1 if side == "src" else 0).alias("src"),
        F.lit(1 if side == "dst" else 0).alias("dst"),
        F.lit(0).alias("asked"),
    )


def verify(src: DataFrame, dst: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(path, status) for every path, or for the paths an ADD or UPDATE names.

    Both inputs have `path`, `digest` (text or binary) and optionally
    `is_file`. A file without a digest on either side is UNKNOWN, never a match. Several rows of a path match when both sides hold the same
    digests equally often. Rows are folded per path and digest first, so a path
    with very many rows is spread and reaches its last step as partial sums.
    """
    rows = _side(exclude_trash(src), "src").unionByName(_side(exclude_trash(dst), "dst"))
    if changes is not None:
        asked = exclude_trash(changes).where(F.col("op").isin(ADD, UPDATE)).select(
            "path",
            F.lit(None).cast("boolean").alias("file"),
            F.lit(None).cast(rows.schema["digest"].dataType).alias("digest"),
            F.lit(0).alias("src"),
            F.lit(0).alias("dst"),
            F.lit(1).alias("asked"),
        )
        rows = rows.unionByName(asked)
    held = rows.groupBy("path", "file", "digest").agg(
        F.sum("src").alias("src"), F.sum("dst").alias("dst"), F.max("asked").alias("asked")
    )
    per_path = held.groupBy("path").agg(
        F.sum("src").alias("src"),
        F.sum("dst").alias("dst"),
        F.bool_and(F.col("src") == F.col("dst")).alias("equal"),
        F.bool_or(F.col("file") & F.col("digest").isNull() & (F.col("src") + F.col("dst") > 0)).alias("undigested"),
        F.max(F.when(F.col("src") > 0, F.col("file"))).alias("src_file"),
        F.max(F.when(F.col("dst") > 0, F.col("file"))).alias("dst_file"),
        F.max("asked").alias("asked"),
    )
    status = (
        F.when((F.col("src") == 0) & (F.col("dst") == 0), NO_BOTH)
        .when(F.col("src") == 0, NO_SOURCE)
        .when(F.col("dst") == 0, NO_TARGET)
        .when(F.col("src_file") != F.col("dst_file"), KIND)
        .when(F.col("undigested"), UNKNOWN)
        .when(F.col("equal") | ~F.col("src_file"), MATCH)
        .otherwise(CONTENT)
    )
    if changes is not None:
        per_path = per_path.where(F.col("asked") == 1)
    return per_path.select("path", status.alias("status"))


def mismatches(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("status") != MATCH)
