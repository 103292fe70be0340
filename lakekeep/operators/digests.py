"""Trees compared from the top down by digests of their folders.

A folder's digest is the sum of the hashes of all rows at or below it, so rows are
folded to a row for each folder, and these climb to their ancestors, in one
aggregation each. Stored by depth, the digests of two trees are compared level by level, and only
below folders that differ; only files that lie in a folder whose own rows differ are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import lineage, parent
from lakekeep.operators.verify import MATCH, exclude_trash, mismatches, verify
from lakekeep.session import pinned

# A digest is four sums of 32-bit hashes and the number of rows.
PARTS = ("h1", "h2", "h3", "h4", "n")
DIGEST_SCHEMA = (
    "folder string, parent string, " + ", ".join(f"own_{p} bigint, whole_{p} bigint" for p in PARTS)
    + ", own_open boolean, whole_open boolean, depth int"
)


def _parts(*values: Column) -> list[Column]:
    low, high = F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)
    bits = F.lit(0xFFFFFFFF).cast("bigint")
    return [low.bitwiseAND(bits), F.shiftrightunsigned(low, 32), high.bitwiseAND(bits), F.shiftrightunsigned(high, 32), F.lit(1).cast("bigint")]


def folder_digests(rows: DataFrame) -> DataFrame:
    """(folder, parent, own.., whole.., own_open, whole_open, depth) of every folder of a tree (path, digest[, is_file]).

    `own` covers the rows directly in the folder, `whole` all below it as well. A folder is open where a file has no digest:
    it is never equal to another. Trash is left out. Rows are counted as often as they occur.
    """
    rows = exclude_trash(rows)
    file = F.coalesce("is_file", F.lit(True)) if "is_file" in rows.columns else F.lit(True)
    digest = F.when(file, F.col("digest"))
    hashed = rows.select(
        parent("path").alias("folder"), (file & F.col("digest").isNull()).alias("open"),
        *[c.alias(p) for c, p in zip(_parts(F.col("path"), file, digest), PARTS, strict=True)],
    )
    own = hashed.groupBy("folder").agg(*[F.sum(p).alias(p) for p in PARTS], F.bool_or("open").alias("open"))
    # Every folder once for each of its ancestors and itself; what it holds itself counts as its own in the last.
    above = lineage("folder")
    climbed = own.select(F.posexplode(above).alias("at", "up"), F.size(above).alias("levels"), *PARTS, "open")
    itself = F.col("at") == F.col("levels") - 1
    zero = F.lit(0).cast("bigint")
    digests = climbed.groupBy("up", "at").agg(
        *[c for p in PARTS for c in (F.sum(F.when(itself, F.col(p)).otherwise(zero)).alias(f"own_{p}"), F.sum(p).alias(f"whole_{p}"))],
        F.bool_or(itself & F.col("open")).alias("own_open"), F.bool_or("open").alias("whole_open"),
    )
    up = F.when(F.col("at") > 0, parent("up"))
    told = [f"{kind}_{p}" for p in PARTS for kind in ("own", "whole")]
    return digests.select(F.col("up").alias("folder"), up.alias("parent"), *told, "own_open", "whole_open", F.col("at").cast("int").alias("depth"))


def write_digests(rows: DataFrame, path: str) -> None:
    """Store the digests of a tree, a folder of files for each depth."""
    folder_digests(rows).hint("rebalance", "depth").write.partitionBy("depth").parquet(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIGEST_SCHEMA).parquet(path)


def _same(kind: str) -> Column:
    equal = ~F.coalesce(f"s_{kind}_open", F.lit(True)) & ~F.coalesce(f"d_{kind}_open", F.lit(True))
    for p in PARTS:
        equal = equal & F.col(f"s_{kind}_{p}").eqNullSafe(F.col(f"d_{kind}_{p}"))
    return equal


def differing_folders(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(folder, own): the folders of two stored digest tables whose subtrees differ; `own` tells that rows directly in them do.

    A level is read only below the differing folders of the level above, and none below the last that has any: equal trees
    are told by their topmost digests. There is a job for each level, on the folders that are still in question.
    """
    def side(df: DataFrame, name: str, level: int, asked: DataFrame | None) -> DataFrame:
        rows = df.where(F.col("depth") == level).drop("depth")
        if asked is not None:
            rows = rows.join(asked, rows["parent"] == asked["_asked"], "left_semi")
        return rows.drop("parent").select("folder", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("folder", "parent")])

    level, asked, found = 0, None, None
    while True:
        met = side(src, "s", level, asked).join(side(dst, "d", level, asked), "folder", "full")
        told = pinned(met.where(~_same("whole")).select("folder", (~_same("own")).alias("own")), "differing")
        if told.isEmpty():
            return told if found is None else found
        found = told if found is None else found.unionByName(told)
        level, asked = level + 1, told.select(F.col("folder").alias("_asked"))


def _in_question(rows: DataFrame, folders: DataFrame, how: str) -> DataFrame:
    owned = rows.withColumn("_folder", parent("path"))
    return owned.join(folders.withColumnRenamed("folder", "_folder"), "_folder", how).select(*rows.columns)


def tree_mismatches(src: DataFrame, dst: DataFrame, src_digests: DataFrame, dst_digests: DataFrame) -> DataFrame:
    """(path, status) of the paths that do not match; of equal trees only the topmost digests are read."""
    folders = pinned(differing_folders(src_digests, dst_digests).where("own").select("folder"), "unequal")
    if folders.isEmpty():
        return src.sparkSession.createDataFrame([], "path string, status string")
    return mismatches(verify(_in_question(src, folders, "left_semi"), _in_question(dst, folders, "left_semi")))


def verify_tree(src: DataFrame, dst: DataFrame, src_digests: DataFrame, dst_digests: DataFrame) -> DataFrame:
    """(path, status) as `verify` gives it for every path.

    Paths in folders with equal rows are listed from the source alone and not compared.
    """
    folders = pinned(differing_folders(src_digests, dst_digests).where("own").select("folder"), "unequal")
    compared = verify(_in_question(src, folders, "left_semi"), _in_question(dst, folders, "left_semi"))
    equal = _in_question(exclude_trash(src), folders, "left_anti").select("path").distinct()
    return compared.unionByName(equal.withColumn("status", F.lit(MATCH)))
