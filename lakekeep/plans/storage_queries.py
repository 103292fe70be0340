"""Queries on text scans, compaction, quarantine and partitions."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.operators.compaction import compact_text, line_count, plan_compaction, swap_compacted
from lakekeep.operators.moves import check_moves, move_files, plan_trash, stored_plan
from lakekeep.operators.partitions import (
    found_partitions, missing_partitions, register_partitions, registered_partitions,
)
from lakekeep.operators.quarantine import (
    move_matching, purge, purge_trash, quarantine, quarantine_files, quarantine_partition, read_trash, write_trash,
)
from lakekeep.operators.usage import partition_usage, table_usage
from lakekeep.plans.inputs import INV, TREES, inventory, tree_at
from lakekeep.plans.registry import query
from lakekeep.plans.usage_queries import GLOB, GLOB_SQL
from lakekeep.session import load, pinned, work_path
from lakekeep.sources.files import read_text_tree, scan_files, scan_partition

BIN_BYTES = 10_000_000
TRASH_DAY, LATER_DAY = "20240101", "20240102"


def document_text(spark: SparkSession, sf: str, by_lang: bool = False) -> str:
    """The documents written out as a folder of text files."""
    path = work_path(spark, "text")
    docs = load(spark, sf, "documents")
    if by_lang:
        docs.select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(path)
    else:
        docs.select(F.col("text").alias("value")).write.text(path)
    return path


LINES_SQL = """lines as (select unnest(string_split(text, chr(10))) line from documents)"""


def by_line(lines: DataFrame) -> DataFrame:
    """Copies of every line; equal lines are folded before the shuffle."""
    return lines.groupBy(F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


@query("text_scan", f"with {LINES_SQL} select md5(line) digest, count(*) copies from lines group by 1")
def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    return by_line(read_text_tree(spark, document_text(spark, sf), "\n"))


@query("line_count", f"with {LINES_SQL} select count(*) lines from lines")
def line_count_query(spark: SparkSession, sf: str) -> DataFrame:
    return line_count(read_text_tree(spark, document_text(spark, sf), "\n"))


@query("compact_roundtrip", f"with {LINES_SQL} select md5(line) digest, count(*) copies from lines group by 1")
def compact_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    goal = work_path(spark, "compact")
    compact_text(spark, document_text(spark, sf), goal, "COLD", 1 << 26, "\n")
    return by_line(read_text_tree(spark, goal, "\n"))


@query("compaction_bins", f"""with {INV},
placed as (select regexp_replace(path, '/[^/]*$', '') dir, path, size,
           cast(sum(size) over (partition by regexp_replace(path, '/[^/]*$', '') order by path
                                rows unbounded preceding) - size as bigint) "before" from inv)
select dir, path, size, "before" // {BIN_BYTES} bin from placed""")
def compaction_bins(spark: SparkSession, sf: str) -> DataFrame:
    return plan_compaction(inventory(spark, sf).select("path", "size"), BIN_BYTES).select("dir", "path", "size", "bin")


@query("file_scan", """
select lang, cast(sum(strlen(text) + 1) as bigint) bytes from documents group by lang""")
def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes per language folder, from file sizes alone."""
    path = document_text(spark, sf, by_lang=True)
    return partition_usage(scan_files(spark, f"{path}/lang=*/*"), ["lang"]).drop("files")


@query("quarantine_kept", "select doc_id, n_chars, lang, text from documents where n_chars >= 400")
def quarantine_kept(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text")
    return quarantine(docs, F.col("n_chars") < 400, TRASH_DAY)[0]


@query("quarantine_trash", f"""
select doc_id, n_chars, lang, text, '{TRASH_DAY}' trash_day from documents where n_chars < 400""")
def quarantine_trash(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text")
    return quarantine(docs, F.col("n_chars") < 400, TRASH_DAY)[1]


@query("quarantine_files", f"""with {INV}
select path, concat('/trash/{TRASH_DAY}', path) trash_path from inv where {GLOB_SQL}""")
def quarantine_files_query(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine_files(inventory(spark, sf), GLOB, "/trash", TRASH_DAY)


@query("purge_day", f"""
select doc_id, n_chars, text, '{LATER_DAY}' trash_day from documents where n_chars >= 400 and lang = 'fr'""")
def purge_day(spark: SparkSession, sf: str) -> DataFrame:
    """Two days of trash on disk, one purged."""
    root = work_path(spark, "trash")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text")
    kept, first = quarantine(docs, F.col("n_chars") < 400, TRASH_DAY)
    write_trash(first.drop("lang"), root, "docs")
    write_trash(quarantine(kept, F.col("lang") == "fr", LATER_DAY)[1].drop("lang"), root, "docs")
    return purge(read_trash(spark, root, "docs", docs.drop("lang").schema), TRASH_DAY)


@query("purge_moved", f"with {LINES_SQL}, by_lang as (select lang, unnest(string_split(text, chr(10))) line from documents) "
       "select lang, md5(line) digest, count(*) copies from by_lang where lang in ('de', 'es') group by 1, 2")
def purge_moved(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders moved to the trash on one day and one on a later day; the first day is purged."""
    trash, path = work_path(spark, "trash"), document_text(spark, sf, by_lang=True)
    move_matching(spark, f"{path}/lang={{en,fr}}", trash, TRASH_DAY)
    later = move_matching(spark, f"{path}/lang=es", trash, LATER_DAY)
    purge_trash(spark, trash, TRASH_DAY)
    left = [at for at in (f"{path}/lang=*", *later) if at]
    lang = F.regexp_extract(F.col("_metadata.file_path"), "/lang=([^/]*)/", 1)
    lines = read_text_tree(spark, left, "\n").select("value", lang.alias("lang"))
    return lines.groupBy("lang", F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


@query("moves_planned", """
select lang, 'done' state, sum(len(string_split(coalesce(text, ''), chr(10))))::bigint as lines from documents group by lang""")
def moves_planned(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a text tree moved to the trash by tasks, in two calls, the first of which does one language; then the plan is checked.

    The lines are counted where the plan says that the files are by then.
    """
    trash, path = work_path(spark, "trash"), document_text(spark, sf, by_lang=True)
    at = work_path(spark, "plan")
    plan = stored_plan(spark, plan_trash(scan_files(spark, f"{path}/lang=*/*"), trash, TRASH_DAY), at)
    move_files(spark, plan.where(F.col("source").contains("/lang=en/")), work_path(spark, "part"))
    move_files(spark, plan, at)
    lang = F.regexp_extract(F.col("_metadata.file_path"), "/lang=([^/]*)/", 1)
    lines = read_text_tree(spark, f"{trash}/{TRASH_DAY}", "\n").select(lang.alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("lines"))
    states = check_moves(spark, at).select(F.regexp_extract("goal", "/lang=([^/]*)/", 1).alias("lang"), "state").distinct()
    return states.join(lines, "lang", "full").select("lang", "state", "lines")


@query("partitions_missing", f"""with {TREES}
select distinct grp status, regexp_extract(path, 'year=([^/]*)', 1) as "year" from new_f
except select distinct grp, regexp_extract(path, 'year=([^/]*)', 1) from old_f""")
def partitions_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions of the newer tree that the older one has no file of."""
    names = ["status", "year"]
    old, new = (
        found_partitions(t.where(F.col("permission").startswith("-")), names)
        for t in (tree_at(spark, sf, "old"), tree_at(spark, sf, "new"))
    )
    return missing_partitions(new, old, names)


@contextmanager
def document_table(spark: SparkSession, sf: str, registered: bool = True) -> Iterator[tuple[str, str]]:
    """(table, folder): the documents as an external table by language; forgotten at the end."""
    folder = work_path(spark, "table")
    table = f"lakekeep_{uuid.uuid4().hex}"
    load(spark, sf, "documents").select("doc_id", "n_chars", "text", "lang").write.partitionBy("lang").parquet(folder)
    spark.sql(
        f"create table {table} (doc_id bigint, n_chars bigint, text string, lang string) using parquet "
        f"partitioned by (lang) location '{folder}'"
    )
    try:
        if registered:
            register_partitions(spark, table, found_partitions(scan_files(spark, f"{folder}/lang=*/*"), ["lang"]))
        yield table, folder
    finally:
        spark.sql(f"drop table {table}")


@query("partition_files", "select doc_id, n_chars, text, lang, true has_file from documents where lang = 'fr'")
def partition_files(spark: SparkSession, sf: str) -> DataFrame:
    with document_table(spark, sf) as (table, _):
        rows = scan_partition(spark, table, ["fr"])
        sized = (F.col("file_path").contains("lang=fr")) & (F.col("file_size") > 0)
        return pinned(rows.select("doc_id", "n_chars", "text", "lang", sized.alias("has_file")))


@query("partition_registry", """
select 'before' step, lang from documents where false
union all select distinct 'after', lang from documents
union all select distinct 'again', lang from documents""")
def partition_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions the catalog knows before, after and after a repeated registration."""
    with document_table(spark, sf, registered=False) as (table, folder):
        found = found_partitions(scan_files(spark, f"{folder}/lang=*/*"), ["lang"])
        steps = [pinned(registered_partitions(spark, table)).withColumn("step", F.lit("before"))]
        for step in ("after", "again"):
            register_partitions(spark, table, found)
            steps.append(pinned(registered_partitions(spark, table)).withColumn("step", F.lit(step)))
        return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query("quarantine_partition", """
select doc_id, n_chars, text, lang, case when lang = 'fr' then 'trash' else 'table' end place from documents""")
def quarantine_partition_query(spark: SparkSession, sf: str) -> DataFrame:
    trash = work_path(spark, "trash")
    with document_table(spark, sf) as (table, _):
        goal = quarantine_partition(spark, table, ["fr"], trash, TRASH_DAY)
        left = pinned(spark.table(table).select("doc_id", "n_chars", "text", "lang"))
        gone = spark.read.schema(left.drop("lang").schema).parquet(goal).withColumn("lang", F.lit("fr"))
    return left.withColumn("place", F.lit("table")).unionByName(gone.withColumn("place", F.lit("trash")))


@query("quarantine_register", """
select 'left' step, lang from documents where lang <> 'fr' group by lang
union all select 'again', lang from documents where lang <> 'fr' group by lang""")
def quarantine_register(spark: SparkSession, sf: str) -> DataFrame:
    """A partition in the trash stays unknown when the table's folders are registered again."""
    with document_table(spark, sf) as (table, folder):
        quarantine_partition(spark, table, ["fr"], work_path(spark, "trash"), TRASH_DAY)
        left = pinned(registered_partitions(spark, table)).withColumn("step", F.lit("left"))
        register_partitions(spark, table, found_partitions(scan_files(spark, f"{folder}/lang=*/*"), ["lang"]))
        again = pinned(registered_partitions(spark, table)).withColumn("step", F.lit("again"))
    return left.unionByName(again)


@query("usage_table", """
select lang, count(*) > 0 has_bytes, true one_form from documents group by lang
union all select 'xx', false, true""")
def usage_table(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of table partitions from the catalog's locations, against those of the whole inventory."""
    with document_table(spark, sf) as (table, folder):
        whole = pinned(partition_usage(scan_files(spark, f"{folder}/lang=*/*"), ["lang"]).withColumnRenamed("bytes", "listed"))
        langs = sorted(r["lang"] for r in registered_partitions(spark, table).collect()) + ["xx"]
        each = [table_usage(spark, table, f"{v} / ").withColumn("lang", F.lit(v)) for v in langs]
        told = pinned(reduce(DataFrame.unionByName, each))
    both = told.join(whole.select("lang", "listed"), "lang", "left")
    return both.select("lang", (F.col("bytes") > 0).alias("has_bytes"), (F.col("bytes") == F.coalesce("listed", F.lit(0))).alias("one_form"))


@query("compact_swap", f"with {LINES_SQL} select 'out' place, md5(line) digest, count(*) copies from lines group by 2 "
       "union all select 'trash', md5(line), count(*) from lines group by 2")
def compact_swap(spark: SparkSession, sf: str) -> DataFrame:
    """A compaction to its end: the new files under a prefix, the originals in the trash."""
    source, made = document_text(spark, sf), work_path(spark, "compact")
    out, trash = work_path(spark, "out"), work_path(spark, "trash")
    compact_text(spark, source, made, "WARM", 1 << 26, "\n")
    swap_compacted(spark, source, made, out, "packed-", trash, TRASH_DAY)
    new = read_text_tree(spark, f"{out}/packed-*", "\n").select(F.lit("out").alias("place"), "value")
    old = read_text_tree(spark, f"{trash}/{TRASH_DAY}", "\n").select(F.lit("trash").alias("place"), "value")
    return new.unionByName(old).groupBy("place", F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("copies"))
