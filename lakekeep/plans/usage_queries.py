"""Queries on space use and on scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import glob_match, partition_value, partition_values, trash_path
from lakekeep.functions.scalars import day_stamp, mode_of, percent, temperature
from lakekeep.operators.split import byte_ranges
from lakekeep.operators.stored_usage import folder_classes, signed_changes, summary_from, updated_classes
from lakekeep.operators.usage import (
    dir_rollup, dir_summary, location_usage, partition_usage, temperature_histogram, usage, usage_cube, year_histogram,
)
from lakekeep.plans.inputs import AS_OF, INV, ROOTS, WHOLE_TREE, inventory, tree_at
from lakekeep.plans.registry import query
from lakekeep.session import load, pinned

GLOB = "/warehouse/orders/status=[FO]/year=*/order-1??"
GLOB_SQL = "regexp_full_match(path, '/warehouse/orders/status=[FO]/year=[^/]*/order-1[^/][^/]')"

ROOTS_SQL = "roots as (select * from (values {}) r(root))".format(", ".join(f"('{r}')" for r in ROOTS))
UNDER_SQL = f"""{INV}, {ROOTS_SQL},
under as (select root, i.* from roots join inv i on i.path = root or starts_with(i.path, concat(root, '/'))),
folders as (
  select distinct folder from (
    select regexp_replace(path, '/[^/]*$', '') folder from inv
    union all select regexp_replace(path, '/[^/]*/[^/]*$', '') from inv
    union all select regexp_replace(path, '/[^/]*/[^/]*/[^/]*$', '') from inv
    union all select '/warehouse')),
counts as (select root, count(*) dirs from roots join folders on folder = root or starts_with(folder, concat(root, '/'))
           group by root),
rollup_ as (
  select r.root, cast(coalesce(sum(u.size), 0) as bigint) bytes, count(u.path) files,
         coalesce(any_value(c.dirs), 0) dirs
  from roots r left join under u on u.root = r.root left join counts c on c.root = r.root group by r.root)"""
HEAT_SQL = f"""case when atime >= timestamp '{AS_OF}' - interval '30 days' then 'HOT'
 when atime >= timestamp '{AS_OF}' - interval '180 days' then 'WARM' else 'COLD' end"""
SUMS_SQL = "count(*) files, cast(sum(size) as bigint) bytes"


@query("glob_filter", f"with {INV} select path, size from inv where {GLOB_SQL}")
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).where(glob_match("path", GLOB)).select("path", "size")


@query("usage_glob", f"""with {INV}
select cast(coalesce(sum(size), 0) as bigint) bytes, count(*) files from inv where {GLOB_SQL}""")
def usage_glob(spark: SparkSession, sf: str) -> DataFrame:
    return usage(inventory(spark, sf), GLOB)


@query("usage_partition", f"""with {INV}
select regexp_extract(path, 'status=([^/]*)', 1) status, regexp_extract(path, 'year=([^/]*)', 1) as "year", {SUMS_SQL}
from inv group by 1, 2""")
def usage_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partition_usage(inventory(spark, sf), ["status", "year"])


@query("dir_rollup", f"with {UNDER_SQL} select * from rollup_")
def dir_rollup_query(spark: SparkSession, sf: str) -> DataFrame:
    return dir_rollup(inventory(spark, sf), ROOTS)


@query("dir_rollup_listed", f"""with {WHOLE_TREE},
leaf as (select path root from new where permission like 'd%')
select l.root, cast(sum(case when n.permission like '-%' then n.size end) as bigint) bytes,
       count(*) filter (where n.permission like '-%') files, count(*) filter (where n.permission like 'd%') dirs
from leaf l join new n on n.path = l.root or starts_with(n.path, concat(l.root, '/')) group by l.root""")
def dir_rollup_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Roots given as a table: the folders of the listing themselves."""
    tree = tree_at(spark, sf, "all")
    roots = tree.where(~F.col("permission").startswith("-")).select(F.col("path").alias("root"))
    return dir_rollup(tree, roots)


@query("hist_mtime_year", f"with {UNDER_SQL} select root, strftime(mtime, '%Y') as \"year\", {SUMS_SQL} from under group by 1, 2")
def hist_mtime_year(spark: SparkSession, sf: str) -> DataFrame:
    return year_histogram(inventory(spark, sf), ROOTS, "mtime")


@query("hist_atime_year", f"with {UNDER_SQL} select root, strftime(atime, '%Y') as \"year\", {SUMS_SQL} from under group by 1, 2")
def hist_atime_year(spark: SparkSession, sf: str) -> DataFrame:
    return year_histogram(inventory(spark, sf), ROOTS, "atime")


@query("hist_temperature", f"with {UNDER_SQL} select root, {HEAT_SQL} temperature, {SUMS_SQL} from under group by 1, 2")
def hist_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return temperature_histogram(inventory(spark, sf), ROOTS, AS_OF)


DIR_SUMMARY_SQL = f"""with {UNDER_SQL}
select root, 'mtime_year' dimension, strftime(mtime, '%Y') as "key", {SUMS_SQL} from under group by 1, 3
union all select root, 'atime_year', strftime(atime, '%Y'), {SUMS_SQL} from under group by 1, 3
union all select root, 'temperature', {HEAT_SQL}, {SUMS_SQL} from under group by 1, 3
union all select root, 'total', 'files', files, bytes from rollup_
union all select root, 'total', 'dirs', dirs, 0 from rollup_"""


@query("dir_summary", DIR_SUMMARY_SQL)
def dir_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    return dir_summary(inventory(spark, sf), ROOTS, AS_OF)


@query("dir_summary_delta", DIR_SUMMARY_SQL)
def dir_summary_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stored table of an older inventory and the changes since.

    In the older one urgent files were missing, files of high priority smaller, of medium priority older in year and
    access, and files of other folders were still there, whose classes and folders come to nothing.
    """
    new = inventory(spark, sf)
    p = F.col("priority")
    old = new.where(p != "1-URGENT").withColumns({
        "size": F.when(p == "2-HIGH", F.col("size") - 1).otherwise(F.col("size")),
        "mtime": F.when(p == "3-MEDIUM", F.col("mtime") - F.expr("interval 1 year")).otherwise(F.col("mtime")),
        "atime": F.when(p == "3-MEDIUM", F.col("atime") - F.expr("interval 200 days")).otherwise(F.col("atime")),
    })
    gone = new.where(p == "5-LOW").withColumn("path", F.replace("path", F.lit("/orders/"), F.lit("/returns/")))
    old = old.unionByName(gone)
    classes = pinned(folder_classes(old), "classes")
    signed = pinned(signed_changes(old, new), "signed")
    return summary_from(updated_classes(classes, signed), ROOTS, AS_OF)


LOCATIONS = [
    ("F", "1995", "/warehouse/orders/status=F/year=1995"), ("F", None, "hdfs://nn:8020//warehouse/orders/status=F/"),
    ("P", "1995", "/warehouse/orders/status=P/year=1995"), ("O", "1996", "/warehouse/orders/status=O/year=1996/"),
    ("O", "1997", "/warehouse/orders/status=O/year=1997"), ("X", "away", "/elsewhere/x"), ("X", "none", "/warehouse/orders/status=O/year=19"),
]
LOCATIONS_SQL = ", ".join(f"('{s}', {'null' if y is None else repr(y)}, '{at}')" for s, y, at in LOCATIONS)


@query("usage_all_partitions", f"""with {INV},
files as (select case when priority = '5-LOW' then concat('/elsewhere/x', path) else path end path, size from inv),
locations(status, "year", location) as (values {LOCATIONS_SQL}),
placed as (select *, rtrim(replace(replace(location, 'hdfs://nn:8020', ''), '//', '/'), '/') place from locations),
owned as (select path, size, (select arg_max(place, length(place)) from placed where starts_with(path, concat(place, '/'))) place from files)
select p.status, p."year", p.location, coalesce(sum(o.size), 0)::bigint bytes, count(o.size) files
from placed p left join owned o on p.place = o.place group by all
union all select null, null, null, sum(size)::bigint, count(*) from owned where place is null having count(*) > 0""")
def usage_all_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions anywhere: one inside another, one outside the table's folder, one without files, names that are prefixes of others."""
    files = inventory(spark, sf).select(
        F.when(F.col("priority") == "5-LOW", F.concat(F.lit("/elsewhere/x"), "path")).otherwise(F.col("path")).alias("path"), "size"
    )
    return location_usage(files, spark.createDataFrame(LOCATIONS, "status string, year string, location string"))


@query("usage_cube", f"""with {UNDER_SQL}
select root, strftime(mtime, '%Y') mtime_year, strftime(atime, '%Y') atime_year, {HEAT_SQL} temperature, {SUMS_SQL}
from under group by 1, 2, 3, 4""")
def usage_cube_query(spark: SparkSession, sf: str) -> DataFrame:
    return usage_cube(inventory(spark, sf), ROOTS, AS_OF)


@query("byte_ranges", """
select doc_id, n_chars, s as "start", least(1000, n_chars - s) as "bytes"
from documents, unnest(range(0, n_chars, 1000)) r(s)""")
def byte_ranges_query(spark: SparkSession, sf: str) -> DataFrame:
    return byte_ranges(load(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 1000)


@query("trash_paths", f"""with {INV}
select path, concat('/trash/', strftime(mtime, '%Y%m%d'), path) trash_path from inv""")
def trash_paths(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select("path", trash_path("/trash", day_stamp("mtime"), "path").alias("trash_path"))


@query("fn_temperature", f"with {INV} select k, {HEAT_SQL} temperature from inv")
def fn_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select("k", temperature("atime", AS_OF).alias("temperature"))


@query("fn_percent", """
select event_id, cast(concat(cast("value" as varchar), 'E-2') as double) share from events""")
def fn_percent(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("% "))
    return load(spark, sf, "events").select("event_id", percent(text).alias("share"))


@query("fn_partition_value", f"""with {INV}
select k, regexp_extract(path, '/year=([^/]*)', 1) as "year", cast(null as varchar) ear_strict,
       regexp_extract(path, 'ear=([^/]*)', 1) ear_loose, cast(null as varchar) absent from inv""")
def fn_partition_value(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select(
        "k",
        partition_value("path", "year").alias("year"),
        partition_value("path", "ear").alias("ear_strict"),
        partition_value("path", "ear", strict=False).alias("ear_loose"),
        partition_value("path", "day").alias("absent"),
    )


@query("fn_partition_values", """
select o_orderkey, concat(o_orderstatus, '|', o_orderpriority) as "values" from orders""")
def fn_partition_values(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("status="), "o_orderstatus", F.lit("/priority="), "o_orderpriority")
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(partition_values(text), "|").alias("values"))


@query("fn_day_stamp", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as \"day\" from orders")
def fn_day_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", day_stamp("o_orderdate").alias("day"))


@query("fn_mode", f"""with {INV} select k, case permission when '-rwxr-x---' then '750'
 when '-rw-rw-r--' then '664' else '644' end as "mode" from inv""")
def fn_mode(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select("k", mode_of("permission").alias("mode"))
