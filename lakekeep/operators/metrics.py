"""Metric points from bean snapshots, in batch or on a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.functions.scalars import LONG, PERCENTAGE_STRING, typed_value

# Bean names.
NAMESYSTEM = "Hadoop:service=NameNode,name=FSNamesystem"
STATE = "Hadoop:service=NameNode,name=FSNamesystemState"
INFO = "Hadoop:service=NameNode,name=NameNodeInfo"
JVM = "Hadoop:service=NameNode,name=JvmMetrics"

# Fields taken from each bean.
NAMESYSTEM_FIELDS = (
    "CapacityTotal", "CapacityUsed", "CapacityRemaining", "FilesTotal", "BlocksTotal",
    "CorruptBlocks", "MissingBlocks", "UnderReplicatedBlocks",
    "PendingReplicationBlocks", "PendingDeletionBlocks",
)
STATE_FIELDS = (
    "NumLiveDataNodes", "NumDeadDataNodes", "NumDecommissioningDataNodes", "VolumeFailuresTotal",
)
USAGE_FIELDS = ("min", "median", "max", "stdDev")
JVM_FIELDS = ("GcCountConcurrentMarkSweep", "GcTimeMillisConcurrentMarkSweep")
HA_STATE = "tag.HAState"
STANDBY = "standby"

# Names of the contact measurements.
CONTACT_FIELDS = ("maxLastContact", "minLastContact", "avgLastContact")

RETENTION_DAYS = 60
WATERMARK = "10 minutes"


def select_beans(beans: DataFrame) -> DataFrame:
    """The four beans that hold metrics; a standby node's namesystem is left out."""
    standby = (F.col("name") == NAMESYSTEM) & F.coalesce(F.col("bean")[HA_STATE] == STANDBY, F.lit(False))
    return beans.where(F.col("name").isin(NAMESYSTEM, STATE, INFO, JVM) & ~standby)


def nested_json(text: Column, schema: str) -> Column:
    """JSON held as text inside JSON."""
    return F.from_json(text, schema)


def field_points(fields: Column, names: tuple[str, ...], kind: str) -> Column:
    """Array of (measurement, value) for fields of a text map; missing ones have a null value."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("measurement"), typed_value(fields[n], kind).alias("value"))
            for n in names
        ]
    )


def unpivot_fields(df: DataFrame, fields: str, names: tuple[str, ...], kind: str) -> DataFrame:
    """One row per field of the map column `fields`."""
    rest = [c for c in df.columns if c != fields]
    points = F.explode(field_points(F.col(fields), names, kind)).alias("p")
    return df.select(*rest, points).select(*rest, "p.measurement", "p.value")


def contacts(bean: Column) -> Column:
    """Seconds since last contact of every live node in one bean."""
    live = nested_json(bean["LiveNodes"], "map<string,struct<lastContact:bigint>>")
    return F.filter(F.transform(F.map_values(live), lambda n: n["lastContact"]), lambda c: c.isNotNull())


def contact_values(seen: Column) -> tuple[Column, Column, Column]:
    """Maximum, minimum and whole-number average; null when no node is live."""
    total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    average = F.when(F.size(seen) > 0, F.call_function("div", total, F.size(seen)))
    return F.array_max(seen), F.array_min(seen), average


def contact_stats(beans: DataFrame) -> DataFrame:
    """Contact statistics per snapshot; the nodes are reduced inside their row."""
    top, low, mean = contact_values(F.col("_seen"))
    infos = beans.where(F.col("name") == INFO).withColumn("_seen", contacts(F.col("bean")))
    return infos.select(
        "ts", "namespace", "node",
        *[v.cast("bigint").alias(n) for n, v in zip(CONTACT_FIELDS, (top, low, mean))],
    )


def metric_points(beans: DataFrame, keep_null: bool = False) -> DataFrame:
    """(ts, namespace, node, measurement, value) of all beans in one pass.

    A missing or unreadable field gives no point; `keep_null` shows it with a
    null value instead, to count such fields.
    """
    bean, name = F.col("bean"), F.col("name")
    usage = nested_json(bean["NodeUsage"], "struct<nodeUsage:map<string,string>>")["nodeUsage"]
    # The nested documents are parsed once per bean, into columns of their own.
    parsed = select_beans(beans).select(
        "ts", "namespace", "node", "name", "bean",
        F.when(name == INFO, usage).alias("_usage"),
        F.when(name == INFO, contacts(bean)).alias("_seen"),
    )
    contact = F.array(
        *[
            F.struct(F.lit(n).alias("measurement"), v.cast("double").alias("value"))
            for n, v in zip(CONTACT_FIELDS, contact_values(F.col("_seen")))
        ]
    )
    points = (
        F.when(name == NAMESYSTEM, field_points(bean, NAMESYSTEM_FIELDS, LONG))
        .when(name == STATE, field_points(bean, STATE_FIELDS, LONG))
        .when(name == INFO, F.concat(field_points(F.col("_usage"), USAGE_FIELDS, PERCENTAGE_STRING), contact))
        .when(name == JVM, field_points(bean, JVM_FIELDS, LONG))
    )
    rows = parsed.select("ts", "namespace", "node", F.explode(points).alias("p"))
    flat = rows.select("ts", "namespace", "node", "p.measurement", "p.value")
    return flat if keep_null else flat.where(F.col("value").isNotNull())


def dedupe_points(points: DataFrame) -> DataFrame:
    """One point per (ts, namespace, measurement): the one of the last node by name, no name being first.

    Of several points of that node the largest value counts, so the result does not
    depend on the order of rows. A plain aggregate, so it folds before the shuffle and also runs on a
    stream that has a watermark on `ts`.
    """
    best = F.max(F.struct(F.col("node").isNotNull(), "node", "value"))
    return points.groupBy("ts", "namespace", "measurement").agg(best.getField("value").alias("value"))


def retain(points: DataFrame, as_of: Column | str, days: int = RETENTION_DAYS) -> DataFrame:
    """Points no older than `days` before `as_of`.

    On a store with a `date` column the days before are not read at all.
    """
    if isinstance(as_of, str):
        first = datetime.fromisoformat(as_of) - timedelta(days=int(days))
        points = points.where(F.col("ts") >= F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz"))
        # A day of margin: the store's days follow the time zone of the session that wrote it.
        day = (first - timedelta(days=1)).date().isoformat()
        return points.where(F.col("date") >= day) if "date" in points.columns else points
    return points.where(F.col("ts") >= as_of - F.expr(f"interval {int(days)} days"))


def windowed(points: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Count, maximum and minimum per tumbling window and measurement."""
    held = points.groupBy(F.window("ts", width).alias("w"), "namespace", "measurement")
    return held.agg(
        F.count(F.lit(1)).alias("points"), F.max("value").alias("max_value"), F.min("value").alias("min_value")
    ).select(F.col("w.start").alias("window_start"), "namespace", "measurement", "points", "max_value", "min_value")
