"""The metric job as a stream: landed snapshots in, deduplicated points out."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lakekeep.operators.metrics import WATERMARK, dedupe_points, metric_points, windowed
from lakekeep.session import hadoop_path
from lakekeep.sources.metric_store import MetricStore
from lakekeep.sources.sinks import with_shards, write_metrics
from lakekeep.sources.snapshots import explode_beans, read_snapshots, stream_snapshots


def point_stream(
    spark: SparkSession, path: str, watermark: str = WATERMARK, max_files: int | None = None
) -> DataFrame:
    """Points of a snapshot folder. A point is final once the watermark passes its time."""
    snapshots = stream_snapshots(spark, path, max_files).withWatermark("ts", watermark)
    return dedupe_points(metric_points(explode_beans(snapshots)))


def window_stream(spark: SparkSession, path: str, width: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling windows over all nodes' points, on the collection period."""
    snapshots = stream_snapshots(spark, path).withWatermark("ts", watermark)
    return windowed(metric_points(explode_beans(snapshots)), width)


def metric_stream(
    spark: SparkSession, path: str, sink: str, checkpoint: str,
    every: str | None = "5 minutes", watermark: str = WATERMARK, max_files: int | None = None,
) -> StreamingQuery:
    """Run the job into a store sharded by day; `every=None` takes what is there and ends.

    Points that the watermark has not passed stay open; `close_stream` writes them when no more are to come.
    """
    points = with_shards(point_stream(spark, path, watermark, max_files))
    writer = (
        points.writeStream.format("parquet")
        .partitionBy("date")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


OBSERVED = "metric_points"


class PointCounters(StreamingQueryListener):
    """Adds up what running streams tell: `totals` has batches, snapshots, points and, for the points, the latest time by stream id.

    Register it with `spark.streams.addListener` before a stream is started.
    """

    def __init__(self) -> None:
        self.totals: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), {"batches": 0, "snapshots": 0, "points": 0, "latest": None})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress.observedMetrics.get(OBSERVED)
        held = self.totals.setdefault(str(event.progress.id), {"batches": 0, "snapshots": 0, "points": 0, "latest": None})
        held["batches"] += 1
        held["snapshots"] += event.progress.numInputRows
        if told is not None:
            held["points"] += told.points
            held["latest"] = max((t for t in (held["latest"], told.latest) if t is not None), default=None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def upsert_stream(
    spark: SparkSession, path: str, store: str, checkpoint: str, every: str | None = "5 minutes",
    max_files: int | None = None, open_from: str | None = None,
) -> StreamingQuery:
    """Run the job into a `MetricStore`, where a later point of a series takes its place at any time.

    There is no watermark and no state: each batch is merged with the shards that it falls into, however old they are.
    A batch that is run again after a crash is known by its number and the id that the checkpoint
    gives the stream, and changes nothing. Points are counted as they pass, for listeners such as `PointCounters`. A new checkpoint begins anew; its points are put in once more, which changes nothing either.
    """
    points = metric_points(explode_beans(stream_snapshots(spark, path, max_files)))
    points = points.observe(OBSERVED, F.count(F.lit(1)).alias("points"), F.max("ts").cast("string").alias("latest"))
    known, stream = threading.Event(), []

    def put(batch: DataFrame, number: int) -> None:
        known.wait()
        MetricStore(batch.sparkSession, store).upsert(batch, stream[0], number, open_from)

    writer = points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    query = writer.trigger(**trigger).start()
    stream.append(query.id)
    known.set()
    return query


POINT_SCHEMA = "ts timestamp, namespace string, measurement string, value double"


def close_stream(spark: SparkSession, path: str, sink: str, closing: str) -> None:
    """Write what an ended stream has left open to a store of its own: the points later than all in its sink.

    The stream writes a time as a whole once the watermark has passed it, so the last time in
    the sink tells which are missing, and only their snapshots are parsed. The sink's own log names its files, hence the second place.
    """
    snapshots = read_snapshots(spark, path)
    fs, at = hadoop_path(spark, sink)
    if fs.exists(at):
        # One value.
        last = spark.read.schema(POINT_SCHEMA).parquet(sink).agg(F.max("ts").cast("string").alias("t")).first().t
        if last is not None:
            snapshots = snapshots.where(F.col("ts") > F.lit(last).cast("timestamp"))
    write_metrics(dedupe_points(metric_points(explode_beans(snapshots))), closing)


def stored_points(spark: SparkSession, *stores: str) -> DataFrame:
    """The points of several stores, such as a stream's sink and what closed it."""
    return reduce(DataFrame.unionByName, [spark.read.schema(POINT_SCHEMA).parquet(s).select("ts", "namespace", "measurement", "value") for s in stores])
