"""Space use kept up by changes: a stored table of folders, and signed rows that are added to it.

A folder's files are counted by year of change and day of access. A change is a
row that comes (sign 1) or one that goes (sign -1), so the table after a change is
the sum of the table before it and the folded changes; classes that have come to nothing
are dropped. The inventory is read once, to begin with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.functions.paths import parent
from lakekeep.functions.scalars import known_atime, temperature, year_of
from lakekeep.operators.keyed import HIT, RIGHT, last_wins, match_unique
from lakekeep.operators.usage import DIMENSIONS, file_flag, normal_root, summary_of

CLASS = ("folder", "f", "mtime_year", "atime_day")
SIGNED = ("path", "is_file", "size", "mtime", "atime")


def signed_changes(old: DataFrame, new: DataFrame, order: Sequence[str] = ("mtime", "size", "atime")) -> DataFrame:
    """(sign, path, is_file, size, mtime, atime): what goes from the old inventory and what comes with the new one.

    The last row of a path counts on either side. Both images of a changed path are here, so no later step needs the inventories.
    """
    was, now = (
        last_wins(df.select("path", file_flag(df).alias("is_file"), *SIGNED[2:]), ["path"], list(order)) for df in (old, new)
    )
    same = F.lit(True)
    for name in SIGNED[1:]:
        same = same & F.col(name).eqNullSafe(F.col(RIGHT + name))
    # Both sides have one row for each path, so neither join can meet a key with many.
    came = match_unique(now, was, ["path"], "left").where(F.col(HIT).isNull() | ~same).select(F.lit(1).alias("sign"), *SIGNED)
    went = match_unique(was, now, ["path"], "left").where(F.col(HIT).isNull() | ~same).select(F.lit(-1).alias("sign"), *SIGNED)
    return came.unionByName(went)


def folder_classes(rows: DataFrame, sign: Column | None = None) -> DataFrame:
    """(folder, f, mtime_year, atime_day, n, bytes) of an inventory, or of signed rows.

    Files count in their folder; a listed folder is a row of its own, with no classes.
    """
    sign = F.lit(1) if sign is None else sign
    f = file_flag(rows)
    day = F.to_date(known_atime("atime"))
    held = rows.select(
        F.when(f, parent("path")).otherwise(normal_root("path")).alias("folder"), f.alias("f"),
        F.when(f, year_of("mtime")).alias("mtime_year"), F.when(f, day).alias("atime_day"),
        sign.cast("bigint").alias("n"), F.when(f, sign * F.coalesce("size", F.lit(0))).otherwise(0).cast("bigint").alias("bytes"),
    )
    return held.groupBy(*CLASS).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def updated_classes(classes: DataFrame, signed: DataFrame) -> DataFrame:
    """The stored classes after signed changes; folders and classes without a row left are gone.

    Only the changes are folded from rows; the stored table has a row for each folder and class.
    """
    both = classes.unionByName(folder_classes(signed, F.col("sign")))
    return both.groupBy(*CLASS).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") != 0)


def summary_from(classes: DataFrame, roots: list[str] | DataFrame, as_of: str) -> DataFrame:
    """`dir_summary` made from stored classes; `as_of` is a midnight, since access times are kept by day."""
    if not as_of.endswith(" 00:00:00"):
        raise ValueError(f"as_of has to be a midnight: {as_of}")
    at = F.col("atime_day").cast("timestamp_ntz")
    f = F.col("f")
    folders = classes.select(
        "folder", "f", "mtime_year", F.when(f, year_of(at)).alias("atime_year"), F.when(f, temperature(at, as_of)).alias("temperature"),
        F.when(f, F.col("n")).otherwise(0).alias("files"), "bytes",
    )
    held = folders.groupBy("folder", "f", *DIMENSIONS).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return summary_of(held, roots)
