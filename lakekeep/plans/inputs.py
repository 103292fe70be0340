"""File trees, listings and snapshots derived from the given tables.

Each input is built twice from the same rule: as a DataFrame for the queries
and as SQL text for their checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.scalars import minute_stamp
from lakekeep.session import load, work_path

AS_OF = "2001-11-04 00:00:00"
SPLIT_DAY = "2000-01-01"
ROOTS = [
    "/warehouse/orders",
    "/warehouse/orders/status=F",
    "/warehouse/orders/status=F/year=1999",
    "/warehouse",
    "/warehouse/unknown",
]


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _order_dir() -> Column:
    return F.concat(
        F.lit("/warehouse/orders/status="), F.col("o_orderstatus"),
        F.lit("/year="), _text(F.year("o_orderdate")),
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a file; its last shipping date is the access time."""
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("atime")
    )
    orders = load(spark, sf, "orders")
    return orders.join(lines, "o_orderkey", "left").select(
        F.concat(_order_dir(), F.lit("/order-"), _text("o_orderkey")).alias("path"),
        F.col("o_orderkey").alias("k"),
        permission_of().alias("permission"),
        F.lit("3").alias("replication"),
        F.concat(F.lit("u"), _text("o_custkey")).alias("owner"),
        F.col("o_orderstatus").alias("grp"),
        F.round("o_totalprice").cast("bigint").alias("size"),
        F.col("o_orderdate").alias("mtime"),
        F.coalesce("atime", F.lit("1970-01-01").cast("timestamp_ntz")).alias("atime"),
        F.col("o_orderpriority").alias("priority"),
    )


INV = """
inv as (
  select concat('/warehouse/orders/status=', o.o_orderstatus, '/year=',
                cast(year(o.o_orderdate) as varchar), '/order-', cast(o.o_orderkey as varchar)) path,
         o.o_orderkey k,
         case o.o_orderpriority when '1-URGENT' then '-rwxr-x---' when '2-HIGH' then '-rw-rw-r--'
              else '-rw-r--r--' end permission,
         '3' replication, concat('u', cast(o.o_custkey as varchar)) "owner", o.o_orderstatus grp,
         cast(round(o.o_totalprice) as bigint) size, o.o_orderdate mtime,
         coalesce(l.atime, timestamp '1970-01-01 00:00:00') atime, o.o_orderpriority priority
  from orders o left join (select l_orderkey, max(l_shipdate) atime from lineitem group by l_orderkey) l
    on o.o_orderkey = l.l_orderkey)"""


def permission_of() -> Column:
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", "-rwxr-x---")
        .when(F.col("o_orderpriority") == "2-HIGH", "-rw-rw-r--")
        .otherwise("-rw-r--r--")
    )


def tree_at(spark: SparkSession, sf: str, state: str) -> DataFrame:
    """A file tree of the orders as a stored table: files and their folders.

    `all` holds every order with all its lines. `old` is the tree before returns:
    orders up to SPLIT_DAY, and those that will be returned whole. `new` is the tree after them: every order
    that is not returned whole, without the lines that are, and touched later where
    lines were accepted. So every order and line is in at least one of the two. The files are
    joined together once; the folders come from what was stored.
    """
    left = F.col("l_returnflag") != "R" if state == "new" else F.lit(True)
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(left, F.col("l_shipdate"))).alias("touched"),
        F.coalesce(F.sum(F.when(left, F.col("l_quantity"))), F.lit(0.0)).alias("grown"),
        F.coalesce(F.sum(F.when(left, F.col("l_partkey"))), F.lit(0)).alias("parts"),
        F.bool_and(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_returnflag") == "A").alias("accepted"),
    )
    returned = F.coalesce("returned", F.lit(False))
    kept = {
        "all": F.lit(True), "old": (F.col("o_orderdate") <= F.lit(SPLIT_DAY).cast("timestamp_ntz")) | returned, "new": ~returned,
    }[state]
    mtime = F.greatest("o_orderdate", "touched")
    if state == "new":
        mtime = F.when(F.coalesce("accepted", F.lit(False)), mtime + F.expr("interval 1 hour")).otherwise(mtime)
    files = (
        load(spark, sf, "orders").join(lines, "o_orderkey", "left").where(kept)
        .select(
            F.concat(_order_dir(), F.lit("/order-"), _text("o_orderkey")).alias("path"),
            permission_of().alias("permission"),
            F.lit("3").alias("replication"),
            F.concat(F.lit("u"), _text("o_custkey")).alias("owner"),
            F.col("o_orderstatus").alias("grp"),
            (F.round("o_totalprice") + F.coalesce("grown", F.lit(0.0))).cast("bigint").alias("size"),
            mtime.alias("mtime"),
            F.col("o_orderpriority").alias("priority"),
            F.concat_ws(":", _text("o_orderkey"), _text(F.coalesce("parts", F.lit(0)))).alias("content"),
        )
    )
    path = work_path(spark, "tree")
    files.write.parquet(path)
    stored = spark.read.schema(files.schema).parquet(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    folders = stored.groupBy(folder.alias("path"), "grp").agg(F.max("mtime").alias("mtime")).select(
        "path", F.lit("drwxr-xr-x").alias("permission"), F.lit("-").alias("replication"),
        F.lit("hdfs").alias("owner"), "grp", F.lit(0).cast("bigint").alias("size"), "mtime",
        F.lit("0-FOLDER").alias("priority"), F.lit(None).cast("string").alias("content"),
    )
    folders.write.mode("append").parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def tree_sql(name: str, state: str) -> str:
    """`name` as a common table expression; `name`_f holds the files alone."""
    left = "l_returnflag <> 'R'" if state == "new" else "true"
    later = "case when l.accepted then interval '1 hour' else interval '0 hour' end" if state == "new" else "interval '0 hour'"
    kept = {
        "all": "true", "old": f"o.o_orderdate <= timestamp '{SPLIT_DAY} 00:00:00' or coalesce(l.returned, false)",
        "new": "not coalesce(l.returned, false)",
    }[state]
    return f"""
{name}_f as (
  select concat('/warehouse/orders/status=', o.o_orderstatus, '/year=',
                cast(year(o.o_orderdate) as varchar), '/order-', cast(o.o_orderkey as varchar)) path,
         case o.o_orderpriority when '1-URGENT' then '-rwxr-x---' when '2-HIGH' then '-rw-rw-r--'
              else '-rw-r--r--' end permission,
         '3' replication, concat('u', cast(o.o_custkey as varchar)) "owner", o.o_orderstatus grp,
         cast(round(o.o_totalprice) + coalesce(l.grown, 0) as bigint) size,
         greatest(o.o_orderdate, l.touched) + {later} mtime, o.o_orderpriority priority,
         concat(cast(o.o_orderkey as varchar), ':', cast(coalesce(l.parts, 0) as varchar)) content
  from orders o left join (
    select l_orderkey, max(case when {left} then l_shipdate end) touched, sum(case when {left} then l_quantity end) grown,
           sum(case when {left} then l_partkey end) parts,
           bool_and(l_returnflag = 'R') returned, bool_or(l_returnflag = 'A') accepted
    from lineitem group by l_orderkey) l
    on o.o_orderkey = l.l_orderkey
  where {kept}),
{name} as (
  select * from {name}_f
  union all
  select regexp_replace(path, '/[^/]*$', ''), 'drwxr-xr-x', '-', 'hdfs', grp, 0, max(mtime), '0-FOLDER', null
  from {name}_f group by 1, grp)"""


TREES = f"{tree_sql('old', 'old')},{tree_sql('new', 'new')}"
# The whole inventory under the name of the newer tree.
WHOLE_TREE = tree_sql("new", "all")


def _spaced_path() -> Column:
    """Priorities of two words put a blank into the path."""
    return F.when(F.col("priority").contains(" "), F.concat("path", F.lit("-"), "priority")).otherwise(F.col("path"))


def listing_text(tree: DataFrame) -> DataFrame:
    """A tree as listing text with padded columns, some lines being no listing lines."""
    line = F.concat(
        "permission", F.lit("   "), "replication", F.lit(" "), "owner", F.lit(" "), "grp",
        F.lit("\t"), _text("size"), F.lit(" "), minute_stamp("mtime"), F.lit(" "), _spaced_path(), F.lit("  "),
    )
    found = F.concat(F.lit("Found "), _text("size"), F.lit(" items"))
    return tree.select(F.when(F.col("priority") == "5-LOW", found).otherwise(line).alias("value"))


def change_text(tree: DataFrame) -> DataFrame:
    """A tree as change text: each priority stands for one kind of line."""
    path = F.when(
        (F.col("priority") == "1-URGENT") & (F.col("grp") == "O"),
        F.concat(F.lit("/warehouse/.Trash"), "path"),
    ).otherwise(_spaced_path())
    word = (
        F.when(F.col("priority") == "2-HIGH", "update")
        .when(F.col("priority") == "3-MEDIUM", "DELETE")
        .when((F.col("priority") == "5-LOW") & (F.col("grp") == "P"), "MOVE")
        .when((F.col("priority") == "0-FOLDER") & (F.col("grp") == "F"), "update")
    )
    # Short lines lack the time; concat_ws leaves nulls out.
    short = (F.col("priority") == "5-LOW") & (F.col("grp") == "O")
    time = F.when(~short, minute_stamp("mtime"))
    return tree.select(
        F.concat_ws(
            " ", word, "permission", "replication", "owner", "grp", _text("size"), time, path
        ).alias("value")
    )


# The change lines as columns, written without any parsing of text.
CHANGES_SQL = """
raw_changes as (
  select *, case when priority = '1-URGENT' and grp = 'O' then concat('/warehouse/.Trash', path)
                 when priority = '4-NOT SPECIFIED' then concat(path, '-', priority) else path end cpath,
         concat_ws(' ', permission, replication, "owner", grp, cast(size as varchar)) head,
         strftime(mtime, '%Y-%m-%d %H:%M') "minute"
  from new),
changes as (
  select case when priority = '2-HIGH' then concat('update ', head, ' ', "minute", ' ', cpath)
              when priority = '3-MEDIUM' then concat('DELETE ', head, ' ', "minute", ' ', cpath)
              when priority = '5-LOW' and grp = 'P' then concat('MOVE ', head, ' ', "minute", ' ', cpath)
              when priority = '5-LOW' and grp = 'O' then concat(head, ' ', cpath)
              when priority = '0-FOLDER' and grp = 'F' then concat('update ', head, ' ', "minute", ' ', cpath)
              else concat(head, ' ', "minute", ' ', cpath) end raw,
         case when priority = '2-HIGH' or (priority = '0-FOLDER' and grp = 'F') then 'UPDATE'
              when priority = '3-MEDIUM' then 'DELETE'
              when priority = '5-LOW' and grp = 'P' then 'MOVE'
              when priority = '5-LOW' and grp = 'O' then null
              when priority = '4-NOT SPECIFIED' then upper(permission)
              else 'ADD' end op,
         case when priority = '4-NOT SPECIFIED' then 'SPECIFIED' else cpath end path,
         case when priority = '4-NOT SPECIFIED' then replication else permission end permission,
         case when priority = '4-NOT SPECIFIED' then grp else "owner" end "owner",
         case when priority = '4-NOT SPECIFIED' then cast(size as varchar) else grp end grp,
         "minute"
  from raw_changes)"""


def metric_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly JSON snapshots of two nodes per event type, assembled from the events.

    Events are folded per hour, type and one of 16 data nodes first, so the
    list gathered into a snapshot has at most 16 entries.
    """
    events = load(spark, sf, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("namespace"),
        F.concat(F.lit("dn"), _text(F.col("user_id") % 16)).alias("dn"),
        "event_id", "user_id", "value", F.floor("value").cast("bigint").alias("v"),
    )
    per_node = events.groupBy("ts", "namespace", "dn").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"), F.sum("v").alias("vsum"),
        F.max("v").alias("vmax"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(F.struct("event_id", "value")).alias("first"), F.max(F.struct("event_id", "value")).alias("last"),
        F.min("user_id").alias("umin"), F.max("user_id").alias("umax"),
    )
    hours = per_node.groupBy("ts", "namespace").agg(
        F.sum("n").alias("n"), F.sum("users").alias("users"), F.sum("vsum").alias("vsum"),
        F.max("vmax").alias("vmax"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("umin").alias("umin"), F.max("umax").alias("umax"),
        F.count(F.lit(1)).alias("live"),
        F.collect_list(F.struct("dn", "vmax")).alias("contacts"),
    )
    nodes = hours.withColumn("node", F.explode(F.array(F.lit("nn1"), F.lit("nn2"))))
    late = F.when(F.col("node") == "nn2", 1).otherwise(0)

    def bean(name: str, **fields: Column) -> Column:
        named = F.lit(f"Hadoop:service=NameNode,name={name}").alias("name")
        return F.to_json(F.struct(named, *[c.alias(k) for k, c in fields.items()]))

    def pct(c: Column) -> Column:
        return F.concat(F.lit(" "), _text(c), F.lit("% "))

    live = F.to_json(
        F.map_from_entries(
            F.transform("contacts", lambda c: F.struct(c["dn"], F.struct((c["vmax"] + late).alias("lastContact"))))
        )
    )
    usage = F.to_json(
        F.struct(
            F.struct(
                pct(F.col("low")).alias("min"), pct(F.col("first.value")).alias("median"),
                pct(F.col("high")).alias("max"), pct(F.col("last.value")).alias("stdDev"),
            ).alias("nodeUsage")
        )
    )
    n = F.col("n")
    beans = [
        bean(
            "FSNamesystem",
            **{"tag.HAState": F.when(F.col("node") == "nn2", "standby").otherwise("active")},
            CapacityTotal=n * 1000, CapacityUsed=F.col("users"), CapacityRemaining=F.col("last.event_id"),
            FilesTotal=n, BlocksTotal=F.col("vsum"), CorruptBlocks=F.col("umin"), MissingBlocks=F.col("umax"),
            UnderReplicatedBlocks=F.col("first.event_id"), PendingReplicationBlocks=F.col("vmax"),
            PendingDeletionBlocks=F.when(F.col("namespace") != "error", n),
        ),
        bean("FSNamesystemState", NumLiveDataNodes=F.col("live") + late, NumDeadDataNodes=16 - F.col("live"),
             NumDecommissioningDataNodes=n + late, VolumeFailuresTotal=F.col("umin")),
        bean("NameNodeInfo", NodeUsage=usage, LiveNodes=live),
        bean("JvmMetrics", GcCountConcurrentMarkSweep=n + late, GcTimeMillisConcurrentMarkSweep=F.col("vsum")),
        bean("RpcActivity", Ignored=n),
    ]
    payload = F.concat(F.lit('{"beans":['), F.concat_ws(",", *beans), F.lit("]}"))
    return nodes.select("ts", "namespace", "node", payload.alias("payload"))


# The same numbers by direct aggregation, without JSON.
METRIC_SQL = """
hours as (
  select date_trunc('hour', ts) ts, event_type namespace, count(*) n, sum(user_id) users,
         sum(cast(floor(value) as bigint)) vsum, max(cast(floor(value) as bigint)) vmax,
         min(value) low, max(value) high, arg_min(value, event_id) first_value, arg_max(value, event_id) last_value,
         min(event_id) first_id, max(event_id) last_id, min(user_id) umin, max(user_id) umax,
         count(distinct user_id % 16) live
  from events group by 1, 2),
contacts as (
  select ts, namespace, max(c) cmax, min(c) cmin, sum(c) csum, count(*) dns
  from (select date_trunc('hour', ts) ts, event_type namespace, max(cast(floor(value) as bigint)) c
        from events group by 1, 2, user_id % 16) group by 1, 2),
nodes as (
  select h.*, c.cmax, c.cmin, c.csum, c.dns, x.node, x.late
  from hours h join contacts c on h.ts = c.ts and h.namespace = c.namespace,
       (values ('nn1', 0), ('nn2', 1)) x(node, late)),
points as (
  select ts, namespace, node, u.measurement, cast(u.value as double) as value
  from nodes, lateral (values
    ('CapacityTotal', case when late = 0 then n * 1000 end), ('CapacityUsed', case when late = 0 then users end),
    ('CapacityRemaining', case when late = 0 then last_id end), ('FilesTotal', case when late = 0 then n end),
    ('BlocksTotal', case when late = 0 then vsum end), ('CorruptBlocks', case when late = 0 then umin end),
    ('MissingBlocks', case when late = 0 then umax end), ('UnderReplicatedBlocks', case when late = 0 then first_id end),
    ('PendingReplicationBlocks', case when late = 0 then vmax end),
    ('PendingDeletionBlocks', case when late = 0 and namespace <> 'error' then n end),
    ('NumLiveDataNodes', live + late), ('NumDeadDataNodes', 16 - live),
    ('NumDecommissioningDataNodes', n + late), ('VolumeFailuresTotal', umin),
    ('maxLastContact', cmax + late), ('minLastContact', cmin + late),
    ('avgLastContact', (csum + dns * late) // dns),
    ('GcCountConcurrentMarkSweep', n + late), ('GcTimeMillisConcurrentMarkSweep', vsum)) u(measurement, value)
  where u.value is not null
  union all
  select ts, namespace, node, u.measurement, cast(concat(cast(u.value as varchar), 'E-2') as double) as value
  from nodes, lateral (values ('min', low), ('median', first_value), ('max', high), ('stdDev', last_value))
    u(measurement, value))"""
