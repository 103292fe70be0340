"""Queries on listings, diffs, migration plans and their application."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.paths import base_name, parent, protected
from lakekeep.functions.scalars import minute_stamp
from lakekeep.operators.diff import exclude_transient, snapshot_diff
from lakekeep.operators.digests import read_digests, verify_tree, write_digests
from lakekeep.operators.keyed import last_wins
from lakekeep.operators.split import split_work
from lakekeep.operators.verify import exclude_trash, verify
from lakekeep.plans.actions import (
    COUNTERS, REMOVE, VERIFY, counters, delete_outcomes, delete_rows, outcomes, plan_actions, plan_source_delete,
)
from lakekeep.plans.apply import apply_changes
from lakekeep.plans.inputs import (
    CHANGES_SQL, INV, TREES, WHOLE_TREE, change_text, inventory, listing_text, tree_at,
)
from lakekeep.plans.registry import query
from lakekeep.plans.sync import run_changes, run_chunks, sync_diff, sync_full, sync_resumable
from lakekeep.session import load, pinned, work_path
from lakekeep.sources.listing import parse_changes, read_changes, read_listing
from lakekeep.sources.sinks import write_changes, write_failures
from lakekeep.sources.snapshot_table import store_snapshot, stored_diff

LISTED = ("permission", "replication", "owner", "grp", "size")
LISTED_SQL = "permission, replication, \"owner\", grp, size, strftime(mtime, '%Y-%m-%d %H:%M') \"minute\", path"


def listed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *LISTED, minute_stamp("mtime").alias("minute"), "path")


def trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tree_at(spark, sf, "old"), tree_at(spark, sf, "new")


def landed_text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = work_path(spark, name)
    lines.write.text(path)
    return path


DIFF_SQL = """with {trees}
select case when o.path is null then 'ADD' when n.path is null then 'DELETE' else 'UPDATE' end op,
       coalesce(n.permission, o.permission) permission, coalesce(n.replication, o.replication) replication,
       coalesce(n."owner", o."owner") "owner", coalesce(n.grp, o.grp) grp, coalesce(n.size, o.size) size,
       strftime(coalesce(n.mtime, o.mtime), '%Y-%m-%d %H:%M') "minute", coalesce(n.path, o.path) path
from old o full join new n on o.path = n.path
where o.path is null or n.path is null or o.permission <> n.permission or o.replication <> n.replication
   or o."owner" <> n."owner" or o.grp <> n.grp or o.size <> n.size {time}"""


@query("diff_full", DIFF_SQL.format(trees=TREES, time="or o.mtime <> n.mtime"))
def diff_full(spark: SparkSession, sf: str) -> DataFrame:
    return listed(snapshot_diff(*trees(spark, sf)), "op")


@query("diff_ignore_time", DIFF_SQL.format(trees=TREES, time=""))
def diff_ignore_time(spark: SparkSession, sf: str) -> DataFrame:
    return listed(snapshot_diff(*trees(spark, sf), ignore_time=True), "op")


@query("diff_bucketed", DIFF_SQL.format(trees=TREES, time="or o.mtime <> n.mtime"))
def diff_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The older tree is kept in buckets and sorted; the diff leaves it where it lies."""
    old, new = trees(spark, sf)
    table = f"snapshot_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store_snapshot(old, table, work_path(spark, "snapshot"), buckets)
    return listed(stored_diff(spark, table, new), "op")


@query("change_lines", f"""
select concat_ws(' ', op, permission, replication, "owner", grp, cast(size as varchar), "minute", path) as "value"
from ({DIFF_SQL.format(trees=TREES, time="or o.mtime <> n.mtime")})""")
def change_lines_query(spark: SparkSession, sf: str) -> DataFrame:
    """The change list as it is written and read back."""
    path = work_path(spark, "changes")
    write_changes(snapshot_diff(*trees(spark, sf)), path)
    return spark.read.text(path)


@query("last_wins", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber
                               order by l_partkey desc, l_suppkey desc, l_quantity desc) rn from lineitem)
where rn = 1""")
def last_wins_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return last_wins(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("listing_scan", f"""with {WHOLE_TREE}
select {LISTED_SQL}, 'valid' status from new where priority <> '5-LOW' and priority not like '% %'
union all select null, null, null, null, null, null,
       case when priority = '5-LOW' then concat('Found ', cast(size as varchar), ' items')
            else concat(permission, '   ', replication, ' ', "owner", ' ', grp, chr(9), cast(size as varchar), ' ',
                        strftime(mtime, '%Y-%m-%d %H:%M'), ' ', path, '-', priority, '  ') end, 'arity'
from new where priority = '5-LOW' or priority like '% %'""")
def listing_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = landed_text(spark, listing_text(tree_at(spark, sf, "all")), "listing")
    valid, invalid = read_listing(spark, path)
    bad = invalid.select(F.col("raw").alias("path"), F.col("reason").alias("status"))
    return listed(valid).withColumn("status", F.lit("valid")).unionByName(bad, allowMissingColumns=True)


@query("change_scan", f"""with {WHOLE_TREE}, {CHANGES_SQL}
select op, case when op is not null then permission end permission, case when op is not null then "owner" end "owner",
       case when op is not null then grp end grp, case when op is not null then path end path, raw from changes""")
def change_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = landed_text(spark, change_text(tree_at(spark, sf, "all")), "changes")
    return read_changes(spark, path).select("op", "permission", "owner", "grp", "path", "raw")


def parsed_changes(new: DataFrame) -> DataFrame:
    return parse_changes(change_text(new).withColumnRenamed("value", "raw"))


def migration(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    return outcomes(parsed_changes(new), old)


OUTCOME_SQL = f"""{TREES}, {CHANGES_SQL},
outcome as (
  select c.*, o.path is not null present, coalesce(o.permission like '-%', false) target_file,
         c.permission like '-%' "file", contains(c.path, '/.Trash/') skipped,
         case when c.op is null or contains(c.path, '/.Trash/') then null
              when c.op not in ('ADD', 'UPDATE', 'DELETE') then 'unknown_op'
              when c.op <> 'DELETE' and c.permission like '-%' and o.path is not null and o.permission not like '-%'
                then 'kind_conflict' end reason
  from changes c left join old o on c.path = o.path)"""

OCTAL_SQL = """case permission when '-rwxr-x---' then '750' when '-rw-rw-r--' then '664'
 when '-rw-r--r--' then '644' when 'drwxr-xr-x' then '755' end"""


@query("plan_actions", f"""with {OUTCOME_SQL},
live as (select *, op in ('ADD', 'UPDATE') builds, op = 'UPDATE' and target_file replaces
         from outcome where op is not null and not skipped and reason is null),
steps as (
  select path, op, 0 seq, 'SKIP' action, null arg from outcome where op is not null and skipped
  union all select path, op, 0, 'FAIL', reason from outcome where reason is not null
  union all select path, op, 1, 'DELETE', null from live where replaces or (op = 'DELETE' and present)
  union all select path, op, 2, 'COPY', null from live where builds and "file"
  union all select path, op, 2, 'MKDIR', null from live where builds and not "file" and (not present or replaces)
  union all select path, op, 3, 'CHOWN', concat("owner", ':', grp) from live where builds
  union all select path, op, 4, 'CHMOD', {OCTAL_SQL} from live where builds
  union all select path, op, 5, 'TIMES', "minute" from live where builds)
select path, concat('/target', path) target, op, seq, action, arg from steps""")
def plan_actions_query(spark: SparkSession, sf: str) -> DataFrame:
    return plan_actions(migration(spark, sf), "/target")


@query("migrate_counters", f"""with {OUTCOME_SQL},
flags as (select *, op is not null and reason is null and not skipped done from outcome)
select count(*) total, count(*) filter (where op is not null and reason is null) succ,
       count(*) filter (where reason is not null) fail, count(*) filter (where op is null) invalid,
       count(*) filter (where done and op = 'ADD') added, count(*) filter (where done and op = 'DELETE') deleted,
       count(*) filter (where done and op = 'UPDATE') updated,
       count(*) filter (where done and op <> 'DELETE' and not "file") mkdir,
       count(*) filter (where done and op <> 'DELETE' and "file") copied,
       count(*) filter (where reason is not null) reduced from flags""")
def migrate_counters(spark: SparkSession, sf: str) -> DataFrame:
    return counters(migration(spark, sf))


@query("migrate_failures", f"""with {OUTCOME_SQL},
numbered as (select *, row_number() over (order by md5(concat('7', chr(31), raw)), raw) - 1 idx, count(*) over () n from outcome)
select cast(idx // greatest(cast(ceil(n / 25.0) as bigint), 1) as integer) chunk, raw, reason
from numbered where reason is not null""")
def migrate_failures(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    chunked = split_work(change_text(new).withColumnRenamed("value", "raw"), 25).drop("idx")
    path = work_path(spark, "failures")
    write_failures(outcomes(parse_changes(chunked), old), path)
    return spark.read.schema("chunk int, raw string, reason string").parquet(path)


def copies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents and a faulty copy: one source lost, one language altered, other texts added."""
    at = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    docs = load(spark, sf, "documents")
    altered = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    lossy = docs.where(F.col("source") != "src7").select(at, F.md5(altered).alias("digest"))
    extra = load(spark, sf, "benchmark").select(
        F.concat(F.lit("/docs/bench/"), F.col("item_id").cast("string")).alias("path"), F.md5("text").alias("digest")
    )
    return docs.select(at, F.md5("text").alias("digest")), lossy.unionByName(extra)


VERIFY_SQL = """
with src as (select concat('/docs/', source, '/', cast(doc_id as varchar)) path, md5(text) digest from documents),
dst as (select concat('/docs/', source, '/', cast(doc_id as varchar)) path,
               md5(case when lang = 'es' then upper(text) else text end) digest
        from documents where source <> 'src7'
        union all select concat('/docs/bench/', cast(item_id as varchar)), md5(text) from benchmark)
select coalesce(s.path, d.path) path,
       case when s.path is null then 'NO_SOURCE' when d.path is null then 'NO_TARGET'
            when s.digest = d.digest then 'MATCH' else 'CONTENT' end status
from src s full join dst d on s.path = d.path"""


@query("verify_content", VERIFY_SQL)
def verify_content(spark: SparkSession, sf: str) -> DataFrame:
    return verify(*copies(spark, sf))


@query("verify_tree", VERIFY_SQL)
def verify_tree_query(spark: SparkSession, sf: str) -> DataFrame:
    """The same from stored folder digests: files are compared in folders that differ alone."""
    sides = [pinned(rows, "side") for rows in copies(spark, sf)]
    digests = []
    for rows in sides:
        path = work_path(spark, "digests")
        write_digests(rows, path)
        digests.append(read_digests(spark, path))
    return verify_tree(*sides, *digests)


@query("verify_changes", f"""with {OUTCOME_SQL}
select distinct c.path,
       case when n.path is null and o.path is null then 'NO_BOTH' when n.path is null then 'NO_SOURCE'
            when o.path is null then 'NO_TARGET'
            when n.permission like 'd%' and o.permission like 'd%' then 'MATCH'
            when n.content = o.content then 'MATCH' else 'CONTENT' end status
from outcome c left join new n on c.path = n.path left join old o on c.path = o.path
where c.op in ('ADD', 'UPDATE') and not contains(c.path, '/.Trash/')""")
def verify_changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    return verify(contents(new), contents(old), parsed_changes(new))


def contents(tree: DataFrame) -> DataFrame:
    return tree.select("path", F.col("permission").startswith("-").alias("is_file"), F.col("content").alias("digest"))


STATUS_SQL = """case when n.path is null and o.path is null then 'no_both' when n.path is null then 'no_source'
            when o.path is null then 'no_target'
            when n.permission like 'd%' and o.permission like 'd%' then null
            when n.content = o.content then null else 'content' end"""


@query("verify_counters", f"""with {TREES}, {CHANGES_SQL},
told as (select c.*, contains(c.path, '/.Trash/') skipped,
                case when c.op in ('ADD', 'UPDATE') and not contains(c.path, '/.Trash/') then {STATUS_SQL} end reason
         from changes c left join new n on c.path = n.path left join old o on c.path = o.path)
select count(*) total, count(*) filter (where op is not null and reason is null) succ,
       count(*) filter (where reason is not null) fail, count(*) filter (where op is null) invalid,
       0::bigint added, 0::bigint deleted, 0::bigint updated, 0::bigint mkdir, 0::bigint copied,
       count(*) filter (where reason is not null) reduced from told""")
def verify_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A verify job makes no changes; mismatches are its failures."""
    old, new = trees(spark, sf)
    lines = pinned(parsed_changes(new), "lines")
    found = verify(contents(new), contents(old), lines)
    return counters(outcomes(lines, old, VERIFY, found), VERIFY)


@query("delete_counters", f"""with {TREES}, {CHANGES_SQL},
told as (select c.*, c.op is not null and exists (select 1 from old o where o.path = c.path and o.permission like '-%') doomed
         from changes c)
select count(*) total, count(*) filter (where op is not null) succ, 0::bigint fail,
       count(*) filter (where op is null) invalid, 0::bigint added, count(*) filter (where doomed) deleted,
       0::bigint updated, 0::bigint mkdir, 0::bigint copied, 0::bigint reduced from told""")
def delete_counters(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    return counters(delete_outcomes(parsed_changes(new), old), REMOVE)


@query("apply_changes", f"with {TREES} select {LISTED_SQL} from new")
def apply_changes_query(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    changes = pinned(snapshot_diff(old, new), "changes")
    return listed(apply_changes(old, new, changes).snapshot)


@query("apply_failures", f"""with {OUTCOME_SQL},
told as (select case when op is not null then path end path, max(op) op from outcome group by 1)
select c.path, c.op, case when c.op is null or c.op not in ('ADD', 'UPDATE', 'DELETE') then 'unknown_op'
                          when n.path is null then 'source_missing' else 'kind_conflict' end reason
from told c left join new n on c.path = n.path left join old o on c.path = o.path
where c.op is null or c.op not in ('ADD', 'UPDATE', 'DELETE')
   or (c.op <> 'DELETE' and (n.path is null or (n.permission like '-%' and o.permission like 'd%')))""")
def apply_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of an unknown op, and those whose source is gone: the trash paths of the change text are not in the tree."""
    old, new = trees(spark, sf)
    return apply_changes(old, new, parsed_changes(new), tree=True).failures


@query("sync_diff", f"""with {TREES}
select {LISTED_SQL} from new where priority <> '5-LOW' and priority not like '% %'""")
def sync_diff_query(spark: SparkSession, sf: str) -> DataFrame:
    """From two listing texts to the synchronised snapshot."""
    old, new = (
        read_listing(spark, landed_text(spark, listing_text(tree_at(spark, sf, state)), "listing"))[0]
        for state in ("old", "new")
    )
    return listed(sync_diff(spark, old, new, work_path(spark, "sync")).snapshot)


@query("sync_full", f"with {WHOLE_TREE} select {LISTED_SQL} from new")
def sync_full_query(spark: SparkSession, sf: str) -> DataFrame:
    return listed(sync_full(spark, tree_at(spark, sf, "all"), work_path(spark, "sync"), stored=True).snapshot)


@query("sync_unchanged", f"""with {TREES}
select {LISTED_SQL}, 0::bigint changes from new""")
def sync_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """A sync of a tree with itself: no change, and the same tree after it."""
    tree = tree_at(spark, sf, "new")
    done = sync_diff(spark, tree, tree, work_path(spark, "sync"), stored=True)
    return listed(done.snapshot).join(done.changes.agg(F.count("*").alias("changes")).hint("broadcast"))


@query("sync_failures", f"""with {TREES}, lost as (select * from new where grp = 'P'),
numbered as (
  select op, path, row_number() over (order by md5(concat(
      '7', chr(31), op, chr(31), coalesce(path, 'NULL'), chr(31), concat(op, ' ', path)))) - 1 idx, count(*) over () n
  from (select 'ADD' op, path from new))
select cast(idx // greatest(cast(ceil(n / 50.0) as bigint), 1) as integer) chunk, concat(op, ' ', path) raw, 'source_missing' reason
from numbered where path in (select path from lost)""")
def sync_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Changes whose source rows were lost before they were applied, by chunk and line."""
    tree = tree_at(spark, sf, "new")
    source = tree.where("grp <> 'P'")
    changes = pinned(tree.select(F.lit("ADD").alias("op"), "path"), "changes")
    return run_changes(spark, tree.where("false"), source, changes, work_path(spark, "sync"), 50, stored=True).failures


GONE_YEAR, BLOCKED = "/year=1995", "/warehouse/orders/status=F/year=1994"
SYNC_TREE_SQL = f"""{TREES},
src as (
  select case when path = '{BLOCKED}' then '-rw-r--r--' else permission end permission, replication, "owner", grp,
         case when path = '{BLOCKED}' then 1 else size end size, mtime, path
  from new where not contains(path, '{GONE_YEAR}') and not starts_with(path, '{BLOCKED}/')),
extra as (
  select permission, replication, "owner", grp, size, mtime,
         case when priority = '2-HIGH' then concat(path, '.part')
              else concat(regexp_replace(path, '/[^/]*$', ''), '/.Trash/', regexp_extract(path, '[^/]*$')) end path
  from old where priority in ('1-URGENT', '2-HIGH')),
gone as (select path from old where permission like 'd%' and path not in (select path from src)),
blocked as (select s.path from src s join old o on s.path = o.path where s.permission like '-%' and o.permission like 'd%')"""


@query("sync_tree", f"""with {SYNC_TREE_SQL}
select {LISTED_SQL}, 'row' state from src where path not in (select path from blocked)
union all select {LISTED_SQL}, 'row' from old where path in (select path from blocked)
union all select {LISTED_SQL}, 'row' from extra e
  where not exists (select 1 from gone g where starts_with(e.path, concat(g.path, '/')))
union all select null, null, null, null, null, null, path, 'kind_conflict' from blocked""")
def sync_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A sync of trees: whole years and a folder are gone from the source, where a file has taken the folder's place.

    The target also holds files that no listing tells of, and transient ones. Those below a deleted folder go
    with it, the others stay; the file does not replace the folder.
    """
    old, new = trees(spark, sf)
    blocked = F.col("path") == BLOCKED
    source = new.where(~F.col("path").contains(GONE_YEAR) & ~F.col("path").startswith(BLOCKED + "/")).withColumns({
        "permission": F.when(blocked, "-rw-r--r--").otherwise(F.col("permission")), "size": F.when(blocked, 1).otherwise(F.col("size")),
    })
    part = old.where("priority = '2-HIGH'").withColumn("path", F.concat("path", F.lit(".part")))
    trash = old.where("priority = '1-URGENT'").withColumn("path", F.concat(parent("path"), F.lit("/.Trash/"), base_name("path")))
    seen = old.unionByName(trash)
    there = seen.unionByName(part)
    done = sync_diff(spark, seen, source, work_path(spark, "sync"), stored=True, tree=True, target=there)
    failed = done.failures.select(F.regexp_extract("raw", "^[^ ]* (.*)$", 1).alias("path"), F.col("reason").alias("state"))
    return listed(done.snapshot).withColumn("state", F.lit("row")).unionByName(failed, allowMissingColumns=True)


@query("sync_resumed", f"""with {TREES}
select {LISTED_SQL} from new""")
def sync_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A sync that ends after ten chunks, and is called again for the others; the result is that of `sync_diff`."""
    old, new = trees(spark, sf)
    out = work_path(spark, "sync")
    sync_resumable(spark, old, new, out, most=10)
    return listed(sync_resumable(spark, old, new, out).synced.snapshot)


@query("sync_counters", f"""with {TREES},
d as (select case when o.path is null then 'ADD' when n.path is null then 'DELETE' else 'UPDATE' end op, n.permission, n.grp
      from old o full join new n on o.path = n.path
      where o.path is null or n.path is null or o.permission <> n.permission or o.replication <> n.replication
         or o."owner" <> n."owner" or o.grp <> n.grp or o.size <> n.size or o.mtime <> n.mtime),
t as (select *, op <> 'DELETE' and grp = 'P' failed from d),
counts as (select count(*) total, count(*) filter (where not failed) succ, count(*) filter (where failed) fail, 0::bigint invalid,
       count(*) filter (where not failed and op = 'ADD') added, count(*) filter (where op = 'DELETE') deleted,
       count(*) filter (where not failed and op = 'UPDATE') updated,
       count(*) filter (where not failed and op <> 'DELETE' and permission like 'd%') mkdir,
       count(*) filter (where not failed and op <> 'DELETE' and permission like '-%') copied,
       count(*) filter (where failed) reduced from t)
select 'observed' form, * from counts union all select 'by chunk', * from counts""")
def sync_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Job counters of a sync whose source has lost rows: as observed by its own job, and added up from a ledger of chunks."""
    old, new = trees(spark, sf)
    changes, source = pinned(snapshot_diff(old, new), "changes"), new.where("grp <> 'P'")
    one = run_changes(spark, old, source, changes, work_path(spark, "sync"), stored=True).counters
    two = run_chunks(spark, old, source, changes, work_path(spark, "sync"), wave=9, stored=True).synced.counters
    rows = [(form, *[counted[n] for n in COUNTERS]) for form, counted in (("observed", one), ("by chunk", two))]
    return spark.createDataFrame(rows, f"form string, {', '.join(f'{n} bigint' for n in COUNTERS)}")


@query("split_work", f"""with {INV}, numbered as (
  select path, row_number() over (order by md5(concat('7', chr(31), path))) - 1 idx, count(*) over () n from inv)
select path, idx, cast(idx // greatest(n // 40, 1) as integer) chunk from numbered""")
def split_work_query(spark: SparkSession, sf: str) -> DataFrame:
    return split_work(inventory(spark, sf).select("path"), 40, mode="floor")


def scattered_path() -> Column:
    """Inventory paths moved under trash, temporary and home folders by priority."""
    p = F.col("priority")
    return (
        F.when(p == "1-URGENT", F.concat(F.lit("/user/a/.Trash"), "path"))
        .when(p == "2-HIGH", F.concat(F.lit("/user/b/_temporary/0"), "path"))
        .when(p == "3-MEDIUM", F.concat(F.lit("/user/"), "owner"))
        .when((p == "5-LOW") & (F.col("grp") == "O"), F.concat(F.lit("/warehouse/_distcp_logs_"), "owner", F.lit("/f")))
        .when((p == "5-LOW") & (F.col("grp") == "F"), F.concat(F.lit("/user/"), "owner", F.lit("/.Trash")))
        .otherwise(F.col("path"))
    )


SCATTERED = """scattered as (select k, case
  when priority = '1-URGENT' then concat('/user/a/.Trash', path)
  when priority = '2-HIGH' then concat('/user/b/_temporary/0', path)
  when priority = '3-MEDIUM' then concat('/user/', "owner")
  when priority = '5-LOW' and grp = 'O' then concat('/warehouse/_distcp_logs_', "owner", '/f')
  when priority = '5-LOW' and grp = 'F' then concat('/user/', "owner", '/.Trash') else path end path from inv)"""


def scattered(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).select("k", scattered_path().alias("path"))


@query("exclude_transient", f"""with {INV}, {SCATTERED} select * from scattered
where not (contains(path, '/.Trash/') or contains(path, '/_temporary/') or contains(path, '/_distcp_logs_'))""")
def exclude_transient_query(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_transient(scattered(spark, sf))


@query("exclude_trash", f"with {INV}, {SCATTERED} select * from scattered where not contains(path, '/.Trash/')")
def exclude_trash_query(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_trash(scattered(spark, sf))


@query("protected_paths", f"""with {INV}, {SCATTERED} select k, path,
  starts_with(path, '/user') and (len(string_split(path, '/')) = 3
    or (len(string_split(path, '/')) = 4 and ends_with(path, '.Trash'))) is_protected from scattered""")
def protected_paths(spark: SparkSession, sf: str) -> DataFrame:
    return scattered(spark, sf).withColumn("is_protected", protected("path"))


@query("source_delete", f"""with {TREES}
select path, true is_file from old where permission like '-%' and path in (select path from new)""")
def source_delete(spark: SparkSession, sf: str) -> DataFrame:
    return plan_source_delete(*trees(spark, sf))


@query("source_survivors", f"""with {TREES}
select {LISTED_SQL} from new where permission like 'd%' or path not in (select path from old)""")
def source_survivors(spark: SparkSession, sf: str) -> DataFrame:
    old, new = trees(spark, sf)
    doomed = pinned(plan_source_delete(old, new), "doomed")
    return listed(delete_rows(new, doomed))


@query("source_delete_recursive", f"""with {TREES}, asked as (select * from old where permission like '-%' or grp <> 'F')
select {LISTED_SQL} from new n
where n.path not in (select path from asked)
  and not exists (select 1 from asked o where o.permission like 'd%' and starts_with(n.path, concat(o.path, '/')))""")
def source_delete_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of one status are not asked for: of these, folders and new files survive."""
    old, new = trees(spark, sf)
    asked = old.where("permission like '-%' or grp <> 'F'")
    doomed = pinned(plan_source_delete(asked, new, recursive=True), "doomed")
    return listed(delete_rows(new, doomed, recursive=True))
