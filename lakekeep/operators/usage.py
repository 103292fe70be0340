"""Space use: by glob, by partition, and by tree root with its breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import (
    as_column, bare_path, glob_match, is_file, lineage, parent, parse_values, partition_value, squeeze,
)
from lakekeep.functions.scalars import known_atime, temperature, year_of
from lakekeep.session import pinned
from lakekeep.sources.files import partition_location, scan_files

DIMENSIONS = ("mtime_year", "atime_year", "temperature")


def totals() -> tuple[Column, Column]:
    size = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    return size.alias("bytes"), F.count(F.lit(1)).alias("files")


def file_flag(inv: DataFrame) -> Column:
    """Is the row a file: by flag, by permission, or always for a bare file list."""
    if "is_file" in inv.columns:
        return F.col("is_file")
    return is_file("permission") if "permission" in inv.columns else F.lit(True)


def summed(groups: GroupedData) -> DataFrame:
    """Partial files and bytes added up."""
    return groups.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def usage(inv: DataFrame, pattern: str) -> DataFrame:
    """One row (bytes, files) for the files a glob names; zeros when there is none."""
    return inv.where(file_flag(inv) & glob_match("path", pattern)).agg(*totals())


def partition_usage(inv: DataFrame, names: Sequence[str]) -> DataFrame:
    """Bytes and files of every partition, read off the `k=v` levels of the paths."""
    valued = inv.where(file_flag(inv)).select(
        "size", *[partition_value("path", n).alias(n) for n in names]
    )
    return valued.groupBy(*names).agg(*totals())


def table_usage(spark: SparkSession, table: str, values: str | Sequence[str]) -> DataFrame:
    """One row (bytes, files) for the files of one table partition; zeros when it has none.

    `values` are the partition's values, in order, as a list or as `v1 / v2`. The
    catalog tells where the partition lies; no row of it is read.
    """
    location = partition_location(spark, table, parse_values(values) if isinstance(values, str) else list(values))
    if location is None:
        return spark.range(0).select(F.lit(0).alias("size")).agg(*totals())
    return scan_files(spark, location, recursive=True).agg(*totals())


def location_usage(inv: DataFrame, locations: DataFrame) -> DataFrame:
    """Bytes and files of every partition of a table, wherever its location lies: (columns.., location, bytes, files).

    `locations` (columns.., location) is what the catalog knows. A file belongs to the longest location above it, so a
    partition may lie inside another; partitions of one location each have its files. One without files has zeros. The row with a null location
    has the files that no partition holds. The inventory is folded to a row for each folder first; these climb to
    their ancestors and meet the locations.
    """
    names = [c for c in locations.columns if c != "location"]
    at = normal_root(squeeze(bare_path("location")))
    known = locations.select(*names, "location", at.alias("_at"))
    folders = inv.where(file_flag(inv)).groupBy(parent("path").alias("folder")).agg(*totals())
    climbed = folders.select("folder", F.explode(lineage("folder")).alias("_at"))
    met = climbed.join(known.select("_at").distinct(), "_at", "left_semi")
    owner = met.groupBy("folder").agg(F.max(F.struct(F.char_length("_at"), "_at")).getField("_at").alias("_at"))
    held = summed(folders.join(owner, "folder", "left").groupBy("_at"))
    zero = F.lit(0).cast("bigint")
    told = known.join(held, "_at", "left").select(*names, "location", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("files", zero).alias("files"))
    rest = held.where(F.col("_at").isNull()).select("bytes", "files")
    return told.unionByName(rest, allowMissingColumns=True)


def normal_root(root: Column | str) -> Column:
    """A root without slashes at its end; all slashes are the root `/`."""
    bare = F.rtrim(as_column(root), F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def roots_table(inv: DataFrame, roots: list[str] | DataFrame) -> DataFrame:
    if not isinstance(roots, DataFrame):
        roots = inv.sparkSession.createDataFrame([(r,) for r in roots], "root string")
    return roots.select(normal_root("root").alias("root")).distinct()


def under_roots(rows: DataFrame, roots: list[str], path: Column | str = "path") -> DataFrame:
    """Every row once for each given root that is its path or an ancestor of it.

    The roots are listed in the plan, however many they are, so nothing is
    joined or shuffled; for long lists a table of roots is the better form.
    """
    named = F.array_distinct(F.array(*[normal_root(F.lit(r)) for r in roots]).cast("array<string>"))
    return rows.withColumn("root", F.explode(F.array_intersect(lineage(path), named)))


def by_folder(inv: DataFrame, as_of: Column | str | None, dims: Sequence[str], store: bool = True) -> DataFrame:
    """(folder, f, dims.., files, bytes): the inventory folded once; stored where several passes read it.

    A folder that is listed, or that holds a file, has a row; rows of listed
    folders have null dims and no files. All sums and folder counts are made from
    this small table.
    """
    made = {
        "mtime_year": lambda: year_of("mtime"),
        "atime_year": lambda: year_of(known_atime("atime")),
        "temperature": lambda: temperature("atime", as_of),
    }
    f = file_flag(inv)
    rows = inv.select(
        F.when(f, parent("path")).otherwise(normal_root("path")).alias("folder"), f.alias("f"),
        *[F.when(f, made[d]()).alias(d) for d in dims], F.when(f, F.col("size")).alias("size"),
    )
    held = rows.groupBy("folder", "f", *dims).agg(
        F.count_if("f").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes")
    )
    return pinned(held, "folders") if store else held


def _climbed(rows: DataFrame, roots: list[str] | DataFrame, dims: Sequence[str]) -> DataFrame:
    """Files and bytes per (root, dims) of rows per folder; roots above no folder are absent."""
    if not isinstance(roots, DataFrame):
        return summed(under_roots(rows, roots, "folder").groupBy("root", *dims))
    # Folders near the top own every row, so rows are folded per ancestor before they meet the roots.
    climbed = summed(rows.withColumn("root", F.explode(lineage("folder"))).groupBy("root", *dims))
    return climbed.join(roots_table(rows, roots), "root", "left_semi")


def _named_files(inv: DataFrame, roots: list[str] | DataFrame, as_of: Column | str | None, dims: Sequence[str]) -> DataFrame | None:
    """Files that are roots themselves: (root, dims.., files, bytes); only rows that a root names are looked at."""
    files = inv.where(file_flag(inv)).join(
        roots_table(inv, roots).withColumnRenamed("root", "path"), "path", "left_semi"
    )
    made = {
        "mtime_year": lambda: year_of("mtime"), "atime_year": lambda: year_of(known_atime("atime")),
        "temperature": lambda: temperature("atime", as_of),
    }
    sized = files.select(F.col("path").alias("root"), "size", *[made[d]().alias(d) for d in dims])
    return sized.groupBy("root", *dims).agg(*totals())


def _cube(
    inv: DataFrame, folders: DataFrame, roots: list[str] | DataFrame, as_of: Column | str | None, dims: Sequence[str],
    file_roots: bool,
) -> DataFrame:
    cube = _climbed(folders.where("f"), roots, dims)
    if file_roots:
        named = _named_files(inv, roots, as_of, dims)
        cube = summed(cube.unionByName(named.select(*cube.columns)).groupBy("root", *dims))
    return cube


def _dirs(folders: DataFrame, roots: list[str] | DataFrame) -> DataFrame:
    """Number of folders at or below each root, listed or implied by a path."""
    every = folders.select("folder").distinct().select(F.explode(lineage("folder")).alias("folder")).distinct()
    counted = _climbed(every.select("folder", F.lit(1).alias("files"), F.lit(0).alias("bytes")), roots, [])
    return counted.select("root", F.col("files").alias("dirs"))


def usage_cube(
    inv: DataFrame, roots: list[str] | DataFrame, as_of: Column | str | None = None,
    dims: Sequence[str] = DIMENSIONS, file_roots: bool = False,
) -> DataFrame:
    """Files and bytes per root and breakdown.

    Roots are folders. `file_roots` says that some may be files; those are found by a second pass.
    """
    return _cube(inv, by_folder(inv, as_of, dims, store=False), roots, as_of, dims, file_roots)


def _rollup(inv: DataFrame, roots: list[str] | DataFrame, sums: DataFrame, dirs: DataFrame) -> DataFrame:
    out = roots_table(inv, roots).join(sums, "root", "left").join(dirs, "root", "left")
    return out.select("root", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("bytes", "files", "dirs")])


def dir_rollup(inv: DataFrame, roots: list[str] | DataFrame, file_roots: bool = False) -> DataFrame:
    """(root, bytes, files, dirs) for every given root; an unknown root gives zeros.

    A root may end in slashes; it comes out without. The answer does not depend on
    how many roots are asked for, nor on whether they come as a list or as a table.
    """
    folders = by_folder(inv, None, ())
    return _rollup(inv, roots, _cube(inv, folders, roots, None, (), file_roots), _dirs(folders, roots))


def year_histogram(inv: DataFrame, roots: list[str] | DataFrame, col: str) -> DataFrame:
    """(root, year, files, bytes) by year of `mtime` or `atime`."""
    dim = {"mtime": "mtime_year", "atime": "atime_year"}[col]
    return usage_cube(inv, roots, dims=[dim]).withColumnRenamed(dim, "year")


def temperature_histogram(inv: DataFrame, roots: list[str] | DataFrame, as_of: Column | str) -> DataFrame:
    return usage_cube(inv, roots, as_of, dims=["temperature"])


def _long_form(cube: DataFrame) -> DataFrame:
    """(root, dimension, key, files, bytes): the cube folded to each breakdown alone."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key"))
            for d in ("mtime_year", "atime_year", "temperature")
        ]
    )
    return summed(
        cube.select("root", "files", "bytes", F.explode(pairs).alias("p"))
        .groupBy("root", F.col("p.dimension").alias("dimension"), F.col("p.key").alias("key"))
    )


def _summary(cube: DataFrame, folders: DataFrame, roots: list[str] | DataFrame) -> DataFrame:
    flat = _rollup(folders, roots, summed(cube.groupBy("root")), _dirs(folders, roots)).select(
        "root",
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("dimension"), F.lit("files").alias("key"),
                         F.col("files").alias("files"), F.col("bytes").alias("bytes")),
                F.struct(F.lit("total").alias("dimension"), F.lit("dirs").alias("key"),
                         F.col("dirs").alias("files"), F.lit(0).cast("bigint").alias("bytes")),
            )
        ).alias("t"),
    ).select("root", "t.*")
    return _long_form(cube).unionByName(flat)


def summary_of(folders: DataFrame, roots: list[str] | DataFrame) -> DataFrame:
    """`dir_summary` of a table of folders and breakdowns such as `by_folder` makes."""
    folders = pinned(folders, "folders")
    return _summary(pinned(_climbed(folders.where("f"), roots, DIMENSIONS), "cube"), folders, roots)


def dir_summary(inv: DataFrame, roots: list[str] | DataFrame, as_of: Column | str, file_roots: bool = False) -> DataFrame:
    """All breakdowns of every root in long form, plus its totals.

    The inventory is read once, into one row per folder, years and temperature;
    all breakdowns, totals and folder counts are folded from that.
    """
    folders = by_folder(inv, as_of, DIMENSIONS)
    return _summary(pinned(_cube(inv, folders, roots, as_of, DIMENSIONS, file_roots), "cube"), folders, roots)


def dir_summary_maps(inv: DataFrame, roots: list[str] | DataFrame, as_of: Column | str, file_roots: bool = False) -> DataFrame:
    """One row per root with six maps, as `dir_summary` holds them in long form.

    A map has one entry per year or temperature, so the collected lists stay short.
    """
    folders = by_folder(inv, as_of, DIMENSIONS)
    cube = pinned(_cube(inv, folders, roots, as_of, DIMENSIONS, file_roots), "cube")
    long = _long_form(cube)

    def folded(dimension: str, value: str) -> Column:
        entry = F.when(F.col("dimension") == dimension, F.struct("key", value))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    maps = long.groupBy("root").agg(
        *[
            folded(d, value).alias(f"{value}_per_{d}") for value in ("files", "bytes") for d in DIMENSIONS
        ]
    )
    return _rollup(inv, roots, summed(cube.groupBy("root")), _dirs(folders, roots)).join(maps, "root", "left")
