"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "lakekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders that local sessions without a setting were given, by application; removed at exit.
_own_roots: dict[str, str] = {}
# Scratch paths handed out and not yet deleted, by application.
_handed_out: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only a session whose driver is its one executor may leave it unset; it gets a folder of
    its own, which goes when the program ends. All others are refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="lakekeep-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return _own_roots[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    path = f"{shared_root(spark)}/lakekeep/{name}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The path's file system and the path as that system knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored within; results have to be written before that."""
    held = _handed_out.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    try:
        yield
    finally:
        for path in held[before:]:
            fs, at = hadoop_path(spark, path)
            fs.delete(at, True)
        del held[before:]


def pinned(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write `df` once and read it back, so that later passes all see one result."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
