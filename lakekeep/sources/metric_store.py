"""A store of metric points in hour and day shards that can be written again at any time.

A shard is a folder of Parquet files: an hour of an open day, or a whole day once it is closed. Shards are never changed in
place. A writer puts new ones below a version of its own and enters them in the
ledger, whose last state names the folder of every shard; readers read these
alone. A writer that stops before its entry leaves files that nobody reads.
"""

from __future__ import annotations

import re
import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.operators.metrics import RETENTION_DAYS
from lakekeep.session import hadoop_path, work_path
from lakekeep.sources.ledger import Ledger

STORED = "ts timestamp, namespace string, measurement string, node string, value double"
COLUMNS = ("ts", "namespace", "measurement", "node", "value")
WHOLE = "all"
# Seconds that a replaced shard is kept for readers that have begun.
GRACE = 3600


def latest(points: DataFrame) -> DataFrame:
    """One point per (ts, namespace, measurement), with its node: the last node's by name, its largest value.

    A maximum, so it does not matter in which order, how often, or in how many steps points are put together.
    """
    best = F.max(F.struct(F.col("node").isNotNull().alias("named"), "node", "value")).alias("best")
    held = points.groupBy("ts", "namespace", "measurement").agg(best)
    return held.select("ts", "namespace", "measurement", F.col("best.node").alias("node"), F.col("best.value").alias("value"))


class MetricStore:
    """The store at a path; every method reads the ledger anew. Days and hours follow the session time zone of its first writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, f"{self.path}/ledger")

    def state(self) -> tuple[int, dict]:
        """`shards`: folder by (date, hour); `batches`: the last batch of every stream."""
        number, state = self.ledger.last()
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        if state is None:
            return number, {"zone": zone, "shards": {}, "batches": {}}
        if state["zone"] != zone:
            raise ValueError(f"the store's time zone is {state['zone']}, the session's {zone}")
        return number, state

    def _folders(self, keys: list[str], state: dict) -> list[str]:
        return [f"{self.path}/data/version={state['shards'][k]}/date={k[:10]}/hour={k[11:]}" for k in keys]

    def _read(self, keys: list[str], state: dict) -> DataFrame:
        """The points of some shards, with `date` and `hour`."""
        schema = f"{STORED}, version string, date string, hour string"
        if not keys:
            return self.spark.createDataFrame([], schema).drop("version")
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*self._folders(keys, state)).drop("version")

    def _write(self, shards: DataFrame) -> str:
        """Points with `date` and `hour` to the folders of a new version; returns its name."""
        version = uuid.uuid4().hex
        rows = shards.hint("rebalance", "date", "hour").sortWithinPartitions("date", "hour", "ts")
        rows.write.partitionBy("date", "hour").parquet(f"{self.path}/data/version={version}")
        return version

    def upsert(self, points: DataFrame, stream: str = "", batch: int | None = None, open_from: str | None = None) -> bool:
        """Put points of any time into the store; returns False where the batch of this stream was put in before.

        Only the shards that the points fall into are read and written again. Closed days stay
        closed, and so are new days before `open_from`. A point that is in the store already changes nothing.
        """
        number, state = self.state()
        if batch is not None and state["batches"].get(stream, -1) >= batch:
            return False
        timed = points.select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in COLUMNS])
        day = F.date_format("ts", "yyyy-MM-dd")
        landed = work_path(self.spark, "upsert")
        timed = timed.where(F.col("ts").isNotNull()).withColumns({"date": day, "hour": F.date_format("ts", "HH")})
        timed.write.parquet(landed)
        held = self.spark.read.schema(timed.schema).parquet(landed)
        # A row for each hour of the batch.
        hours = [(r.date, r.hour) for r in held.select("date", "hour").distinct().collect()]
        closed = {k[:10] for k in state["shards"] if k.endswith(f"/{WHOLE}")}
        fresh = {d for d, _ in hours} - {k[:10] for k in state["shards"]}
        closed |= {d for d in fresh if open_from is not None and d < open_from}
        touched = sorted({f"{d}/{WHOLE if d in closed else h}" for d, h in hours})
        if touched:
            hour = F.when(F.col("date").isin(*closed), WHOLE).otherwise(F.col("hour")) if closed else F.col("hour")
            stored = self._read([k for k in touched if k in state["shards"]], state)
            merged = latest(stored.select(*COLUMNS).unionByName(held.select(*COLUMNS)))
            merged = merged.withColumns({"date": day, "hour": F.date_format("ts", "HH")}).withColumn("hour", hour)
            version = self._write(merged)
            state["shards"] |= dict.fromkeys(touched, version)
        if batch is not None:
            state["batches"][stream] = batch
        if touched or batch is not None:
            self.ledger.commit(state, number)
        fs, at = hadoop_path(self.spark, landed)
        fs.delete(at, True)
        return True

    def close_days(self, before: str) -> list[str]:
        """Merge the hours of the open days before `before` into one shard each; returns these days."""
        number, state = self.state()
        keys = sorted(k for k in state["shards"] if not k.endswith(f"/{WHOLE}") and k[:10] < before)
        days = sorted({k[:10] for k in keys})
        if days:
            version = self._write(self._read(keys, state).withColumn("hour", F.lit(WHOLE)))
            left = {k: v for k, v in state["shards"].items() if k not in set(keys)}
            self.ledger.commit(state | {"shards": left | {f"{d}/{WHOLE}": version for d in days}}, number)
        return days

    def expire(self, as_of: str, days: int = RETENTION_DAYS) -> list[str]:
        """Drop the shards of the days that lie wholly before the kept time; returns these days."""
        first = datetime.fromisoformat(as_of) - timedelta(days=int(days))
        number, state = self.state()
        gone = sorted({k[:10] for k in state["shards"] if datetime.fromisoformat(k[:10]) + timedelta(days=1) <= first})
        if gone:
            self.ledger.commit(state | {"shards": {k: v for k, v in state["shards"].items() if k[:10] not in gone}}, number)
        return gone

    def read(self, since: str | None = None) -> DataFrame:
        """(ts, namespace, measurement, node, value, date, hour); shards that end before `since` are not looked at."""
        _, state = self.state()
        if since is None:
            return self._read(sorted(state["shards"]), state)
        first = datetime.fromisoformat(since)
        kept = [k for k in sorted(state["shards"]) if _end(k) > first]
        return self._read(kept, state).where(F.col("ts") >= F.lit(first.isoformat(sep=" ")).cast("timestamp"))

    def vacuum(self, grace: int = GRACE) -> int:
        """Delete the shard folders that the last state does not name and that are older than `grace` seconds; returns their number."""
        _, state = self.state()
        named = {re.sub("^.*/data/", "", f) for f in self._folders(list(state["shards"]), state)}
        fs, top = hadoop_path(self.spark, f"{self.path}/data")
        if not fs.exists(top):
            return 0
        until, gone = (time.time() - grace) * 1000, 0
        for version in fs.listStatus(top):
            days = [d for d in fs.listStatus(version.getPath()) if d.isDirectory()]
            held = [h for d in days for h in fs.listStatus(d.getPath()) if h.isDirectory()]
            old = [h for h in held if re.sub("^.*/data/", "", h.getPath().toString()) not in named and h.getModificationTime() <= until]
            for hour in old:
                fs.delete(hour.getPath(), True)
            gone += len(old)
            if len(old) == len(held) and version.getModificationTime() <= until:
                fs.delete(version.getPath(), True)
        return gone


def _end(key: str) -> datetime:
    """When a shard's time ends."""
    day, hour = datetime.fromisoformat(key[:10]), key[11:]
    return day + (timedelta(days=1) if hour == WHOLE else timedelta(hours=int(hour) + 1))
