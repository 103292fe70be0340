"""Queries on metric snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.functions.scalars import minute_stamp
from lakekeep.operators.metrics import (
    CONTACT_FIELDS, contact_stats, dedupe_points, metric_points, retain, select_beans, windowed,
)
from lakekeep.plans.inputs import METRIC_SQL, metric_snapshots
from lakekeep.plans.registry import query
from lakekeep.session import load, pinned, work_path
from lakekeep.sources.metric_store import MetricStore
from lakekeep.sources.sinks import expire_metrics, write_metrics
from lakekeep.sources.snapshots import broken_snapshots, explode_beans
from lakekeep.streaming.metrics import close_stream, metric_stream, stored_points, upsert_stream

MINUTE_SQL = "strftime(ts, '%Y-%m-%d %H:%M')"
RETAIN_FROM, RETAIN_TO = "2024-01-10 00:00:00", "2024-03-10 00:00:00"
DEDUPED_SQL = f"""{METRIC_SQL},
kept as (select ts, namespace, measurement, arg_max("value", node) as "value" from points group by 1, 2, 3)"""


def beans(spark: SparkSession, sf: str) -> DataFrame:
    return explode_beans(metric_snapshots(spark, sf))


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", minute_stamp("ts"))


BEAN_NAMES = """(values ('FSNamesystem'), ('FSNamesystemState'), ('NameNodeInfo'), ('JvmMetrics'), ('RpcActivity')) b(bean)"""


@query("jmx_beans", f"""with {METRIC_SQL}
select {MINUTE_SQL} ts, namespace, node, concat('Hadoop:service=NameNode,name=', bean) as "name"
from nodes, {BEAN_NAMES}""")
def jmx_beans(spark: SparkSession, sf: str) -> DataFrame:
    return timed(beans(spark, sf).drop("bean"))


@query("jmx_active", f"""with {METRIC_SQL}
select {MINUTE_SQL} ts, namespace, node, concat('Hadoop:service=NameNode,name=', bean) as "name"
from nodes, {BEAN_NAMES} where bean <> 'RpcActivity' and not (bean = 'FSNamesystem' and node = 'nn2')""")
def jmx_active(spark: SparkSession, sf: str) -> DataFrame:
    return timed(select_beans(beans(spark, sf)).drop("bean"))


@query("metric_points", f"""with {METRIC_SQL}
select {MINUTE_SQL} ts, namespace, node, measurement, "value" from points""")
def metric_points_query(spark: SparkSession, sf: str) -> DataFrame:
    return timed(metric_points(beans(spark, sf)))


@query("metric_dedupe", f"""with {DEDUPED_SQL}
select {MINUTE_SQL} ts, namespace, measurement, "value" from kept""")
def metric_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return timed(dedupe_points(metric_points(beans(spark, sf))))


@query("metric_retained", f"""with {DEDUPED_SQL}
select {MINUTE_SQL} ts, namespace, measurement, "value" from kept where ts >= timestamp '{RETAIN_FROM}'""")
def metric_retained(spark: SparkSession, sf: str) -> DataFrame:
    """What 60 days of retention leave in the sharded store."""
    store = work_path(spark, "metrics")
    points = dedupe_points(metric_points(beans(spark, sf)))
    write_metrics(points, store)
    stored = spark.read.schema(points.schema.add("date", "string")).parquet(store)
    return timed(retain(stored, RETAIN_TO)).drop("date")


@query("metric_expired", f"""with {DEDUPED_SQL}
select distinct strftime(ts, '%Y-%m-%d') as "day", ts::date + 1 > timestamp '{RETAIN_FROM}' held from kept""")
def metric_expired(spark: SparkSession, sf: str) -> DataFrame:
    """The days of the store, and whether they are still there after what lies before the kept time was dropped."""
    store = work_path(spark, "metrics")
    points = dedupe_points(metric_points(beans(spark, sf)))
    write_metrics(points, store)
    schema = points.schema.add("date", "string")
    days = pinned(spark.read.schema(schema).parquet(store).select(F.col("date").alias("day")).distinct())
    expire_metrics(spark, store, RETAIN_TO, 60)
    left = spark.read.schema(schema).parquet(store).select(F.col("date").alias("day"), F.lit(True).alias("left")).distinct()
    return days.join(left, "day", "left").select("day", F.coalesce("left", F.lit(False)).alias("held"))


@query("jmx_broken", f"""with {METRIC_SQL}
select {MINUTE_SQL} ts, namespace, node, case namespace when 'error' then 'json' when 'click' then 'beans' else 'missing' end reason
from nodes where namespace in ('error', 'click', 'view')""")
def jmx_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots cut short, without beans or without payload are told with the reason."""
    payload = (
        F.when(F.col("namespace") == "error", F.substring("payload", 1, 100))
        .when(F.col("namespace") == "click", F.lit('{"other": []}'))
        .when(F.col("namespace") != "view", F.col("payload"))
    )
    broken = broken_snapshots(metric_snapshots(spark, sf).withColumn("payload", payload))
    return timed(broken.drop("payload"))


@query("contact_stats", f"""with {METRIC_SQL}
select {MINUTE_SQL} ts, namespace, node, cmax + late "maxLastContact", cmin + late "minLastContact",
       cast((csum + dns * late) // dns as bigint) "avgLastContact" from nodes""")
def contact_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    return timed(contact_stats(beans(spark, sf))).select("ts", "namespace", "node", *CONTACT_FIELDS)


@query("metric_window", """
select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M') window_start, event_type namespace,
       'value' measurement, count(*) points, max("value") max_value, min("value") min_value
from events group by 1, 2""")
def metric_window(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a point of its type's series, on the collection period."""
    points = load(spark, sf, "events").select(
        "ts", F.col("event_type").alias("namespace"), F.lit("value").alias("measurement"), "value"
    )
    return windowed(points).withColumn("window_start", minute_stamp("window_start"))


@query("metric_stream", f"""with {DEDUPED_SQL}
select {MINUTE_SQL} ts, namespace, measurement, "value" from kept""")
def metric_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots landed as JSON files, taken up by the stream, closed, and read back from its store."""
    landed, store = work_path(spark, "landed"), work_path(spark, "metrics")
    metric_snapshots(spark, sf).write.json(landed)
    metric_stream(spark, landed, store, work_path(spark, "stream"), every=None).awaitTermination()
    closing = work_path(spark, "closing")
    close_stream(spark, landed, store, closing)
    return timed(stored_points(spark, store, closing))


@query("metric_stream_late", f"""with {DEDUPED_SQL}
select {MINUTE_SQL} ts, namespace, measurement, "value" from kept""")
def metric_stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of every other day land after those of later days; their points count all the same."""
    landed, store, checkpoint = (work_path(spark, name) for name in ("landed", "metrics", "stream"))
    snapshots = pinned(metric_snapshots(spark, sf), "snapshots")
    late = F.dayofmonth("ts") % 2 == 0
    for part in (snapshots.where(~late), snapshots.where(late)):
        part.write.mode("append").json(landed)
        upsert_stream(spark, landed, store, checkpoint, every=None, open_from="9999-01-01").awaitTermination()
    return timed(MetricStore(spark, store).read()).select("ts", "namespace", "measurement", "value")


OPEN_FROM, CLOSED_BEFORE = "2024-01-20", "2024-01-26"


@query("metric_shards", f"""with {DEDUPED_SQL},
shards as (select *, strftime(ts, '%Y-%m-%d') "date", strftime(ts, '%H') h from kept where ts >= timestamp '{RETAIN_FROM}')
select "date", case when "date" < '{CLOSED_BEFORE}' then 'all' else h end "hour", count(*) points, min("value") low, max("value") high
from shards group by 1, 2""")
def metric_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The shards of a store: hours of open days, one of each closed day, and none of the days whose time is over.

    The points come in two parts, the second of which also falls into days that are closed by then.
    """
    store = MetricStore(spark, work_path(spark, "metrics"))
    points = pinned(metric_points(beans(spark, sf)), "points")
    early = F.hour("ts") < 12
    store.upsert(points.where(early), open_from=OPEN_FROM)
    store.close_days(CLOSED_BEFORE)
    store.upsert(points.where(~early))
    store.expire(RETAIN_TO, 60)
    return store.read().groupBy("date", "hour").agg(
        F.count(F.lit(1)).alias("points"), F.min("value").alias("low"), F.max("value").alias("high")
    )
