"""Even work chunks in random order, and byte ranges of large objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.session import pinned

# The first digits of the shuffle hash give 16 ** BUCKET_DIGITS buckets. Their
# sizes are even, since the hash is; their number bounds the offset table.
BUCKET_DIGITS = 4
COPY_BLOCK = 1_000_000
# Rows of a bucket from which on it is taken to hold many copies; buckets of very large tables may be larger.
BUCKET_ROWS = 100_000
# Rows of neighbouring indexes that go to one task.
TASK_ROWS = 250_000


def whole(value: Column, by: Column) -> Column:
    """Whole-number quotient, without a detour over doubles."""
    return F.call_function("div", value, by)


def row_digest(columns: list[str], seed: int) -> Column:
    """md5 of the seed and a row's values, parted by a unit separator; nulls are the text NULL."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *values))


def split_work(df: DataFrame, n: int, seed: int = 7, mode: str = "even") -> DataFrame:
    """Shuffle rows and cut them into contiguous chunks; adds `idx` and `chunk`.

    `mode='even'` gives at most n chunks; `'floor'` takes floor(rows / n) rows
    per chunk, at least one, so a remainder makes extra chunks.

    The order is that of `row_digest`, so every attempt of a task sees the same
    one and nothing has to be pinned. The sizes of the hash buckets are counted when this is called. A
    row's index is the number of rows in earlier buckets plus its place in its
    own bucket. Buckets go to tasks by their chunk and place, so the rows meet in one shuffle, and those of a task lie
    together. Only many exact copies make a bucket large; where one is, copies are counted before the
    shuffle and written out in spread blocks after it, so rows that are alike never meet in one task.
    `df` is run for the sizes and again for the rows, so it had better be a stored table.
    """
    if mode not in ("even", "floor"):
        raise ValueError(f"unknown mode: {mode}")
    columns = df.columns
    digest = row_digest(columns, seed)
    bucket = F.substring("_h", 1, BUCKET_DIGITS)
    # At most 16 ** BUCKET_DIGITS rows, so one ordered window and a broadcast are safe.
    sizes = pinned(df.select(digest.alias("_h")).groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    told = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("total"), F.coalesce(F.max("_size"), F.lit(0)).alias("top")).first()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")))
    rounding = n - 1 if mode == "even" else 0
    size = F.lit(max((told["total"] + rounding) // n, 1))

    if told["top"] <= max(BUCKET_ROWS, 4 * told["total"] // 16**BUCKET_DIGITS):
        rows = df.withColumn("_h", digest).withColumn("_b", bucket).join(offsets, "_b", "left")
        goes = [whole(F.col("_base"), size).alias("_c"), whole(F.col("_base"), F.lit(TASK_ROWS)).alias("_p")]
        dealt = rows.select(*columns, F.unhex("_h").alias("_h"), "_b", "_base", *goes).repartition("_c", "_p")
        inside = Window.partitionBy("_c", "_p", "_b").orderBy("_h", *columns)
        indexed = dealt.withColumn("idx", F.col("_base") + F.row_number().over(inside) - 1)
    else:
        rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        rows = rows.withColumn("_h", digest).withColumn("_b", bucket)
        inside = Window.partitionBy("_b").orderBy("_h", *columns)
        place = F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1))
        placed = rows.withColumn("_place", F.coalesce(place, F.lit(0))).join(offsets, "_b", "left")
        first = F.col("_base") + F.col("_place")
        last = first + F.col("_copies") - 1
        runs = placed.withColumn("_last", last).withColumn("_from", F.explode(F.sequence(first, last, F.lit(COPY_BLOCK))))
        upto = F.least(F.col("_last"), F.col("_from") + COPY_BLOCK - 1)
        spread = runs.repartition(whole(F.col("_from"), F.lit(TASK_ROWS)))
        indexed = spread.withColumn("idx", F.explode(F.sequence("_from", upto)))
    chunk = whole(F.col("idx"), size).cast("int")
    return indexed.select(*columns, F.col("idx").cast("bigint").alias("idx"), chunk.alias("chunk"))


def byte_ranges(df: DataFrame, length: str, block: int) -> DataFrame:
    """(.., start, bytes): full blocks, then one partial; nothing for length zero."""
    sized = df.where(F.col(length) > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1, F.lit(block).cast("bigint"))
    return sized.withColumn("start", F.explode(starts)).withColumn(
        "bytes", F.least(F.lit(block).cast("bigint"), F.col(length) - F.col("start"))
    )
