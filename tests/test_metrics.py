"""Metric points in batch and on a stream."""

import json

from compare import spark_rows
from pyspark.sql import functions as F

from lakekeep.operators.metrics import (
    INFO, JVM, NAMESYSTEM, STATE, contact_stats, dedupe_points, metric_points, retain, unpivot_fields,
)
from lakekeep.sources.snapshots import SNAPSHOT_SCHEMA, broken_snapshots, explode_beans, read_snapshots
from lakekeep.streaming.metrics import close_stream, stored_points, metric_stream, window_stream

STORE = "ts timestamp, namespace string, measurement string, value double"


def snapshot(ts, node="nn1", state="active", contacts=(3, 4), drop=(), namespace="ns"):
    beans = [
        {"name": NAMESYSTEM, "tag.HAState": state, "CapacityTotal": 2**53 + 1, "FilesTotal": 7},
        {"name": STATE, "NumLiveDataNodes": len(contacts)},
        {
            "name": INFO,
            "NodeUsage": json.dumps({"nodeUsage": {"min": "0.10%", "median": "12.34%", "max": "50%", "stdDev": "1%"}}),
            "LiveNodes": json.dumps({f"dn{i}": {"lastContact": c, "usedSpace": 1} for i, c in enumerate(contacts)}),
        },
        {"name": JVM, "GcCountConcurrentMarkSweep": 5, "GcTimeMillisConcurrentMarkSweep": 6},
        {"name": "Hadoop:service=NameNode,name=Other", "X": 1},
    ]
    beans = [{k: v for k, v in b.items() if k not in drop} for b in beans]
    return {"ts": ts, "namespace": namespace, "node": node, "payload": json.dumps({"beans": beans})}


def land(folder, name, *snapshots):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(s) + "\n" for s in snapshots))


def beans(spark, tmp_path, *snapshots):
    land(tmp_path / "in", "a.json", *snapshots)
    return explode_beans(read_snapshots(spark, str(tmp_path / "in")))


def values(df):
    return {(r.node, r.measurement): r.value for r in df.collect()}


T = "2024-01-01T00:00:00Z"


def test_points(spark, tmp_path):
    got = values(metric_points(beans(spark, tmp_path, snapshot(T))))
    assert got == {
        ("nn1", "CapacityTotal"): float(2**53 + 1), ("nn1", "FilesTotal"): 7.0, ("nn1", "NumLiveDataNodes"): 2.0,
        ("nn1", "min"): 0.001, ("nn1", "median"): 0.1234, ("nn1", "max"): 0.5, ("nn1", "stdDev"): 0.01,
        ("nn1", "maxLastContact"): 4.0, ("nn1", "minLastContact"): 3.0, ("nn1", "avgLastContact"): 3.0,
        ("nn1", "GcCountConcurrentMarkSweep"): 5.0, ("nn1", "GcTimeMillisConcurrentMarkSweep"): 6.0,
    }


def test_standby_and_missing(spark, tmp_path):
    df = beans(spark, tmp_path, snapshot(T, "nn2", "standby", (), drop=("NodeUsage",)))
    got = values(metric_points(df))
    assert got == {
        ("nn2", "NumLiveDataNodes"): 0.0, ("nn2", "GcCountConcurrentMarkSweep"): 5.0,
        ("nn2", "GcTimeMillisConcurrentMarkSweep"): 6.0,
    }
    assert metric_points(df, keep_null=True).where("value is null").count() == 10
    stats = contact_stats(df).first()
    assert (stats.maxLastContact, stats.minLastContact, stats.avgLastContact) == (None, None, None)


def test_broken_payload_gives_no_point(spark, tmp_path):
    broken = {"ts": T, "namespace": "ns", "node": "nn1", "payload": "{not json"}
    assert metric_points(beans(spark, tmp_path, broken)).count() == 0
    rows = [{**broken, "node": n, "payload": p} for n, p in (("a", "{not json"), ("b", "{}"), ("c", None), ("d", '{"beans":[]}'))]
    land(tmp_path / "odd", "a.json", *rows)
    told = broken_snapshots(read_snapshots(spark, str(tmp_path / "odd")))
    assert {r.node: r.reason for r in told.collect()} == {"a": "json", "b": "beans", "c": "missing"}


def test_last_node_wins(spark, tmp_path):
    df = beans(spark, tmp_path, snapshot(T, "nn2", contacts=(9, 9)), snapshot(T, "nn1"))
    got = {r.measurement: r.value for r in dedupe_points(metric_points(df)).collect()}
    assert got["maxLastContact"] == 9.0 and len(got) == 12


def test_ties_of_one_node_do_not_depend_on_order(spark):
    rows = [("t", "n", "m", "nn1", 1.0), ("t", "n", "m", "nn1", 2.0), ("t", "n", "o", None, 3.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "ts string, namespace string, measurement string, node string, value double").coalesce(1)
        assert {r.measurement: r.value for r in dedupe_points(df).collect()} == {"m": 2.0, "o": 3.0}


def test_retention(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' ts union all select timestamp_ntz'2023-12-31 23:59:59'")
    assert retain(rows, "2024-03-01 00:00:00").count() == 1


def test_unpivot(spark):
    df = spark.sql("select 1 k, map('a', '5', 'b', '7%') m")
    assert spark_rows(unpivot_fields(df, "m", ("a",), "LONG")) == {(1, "a", 5.0): 1}
    assert spark_rows(unpivot_fields(df, "m", ("b",), "PERCENTAGE_STRING")) == {(1, "b", 0.07): 1}


def run(spark, tmp_path, **more):
    metric_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"), every=None, **more
    ).awaitTermination()
    stored = spark.read.schema(STORE).parquet(str(tmp_path / "store"))
    rows = stored.where("measurement = 'maxLastContact'")
    return {r.t: r.value for r in rows.select(F.date_format("ts", "HH:mm").alias("t"), "value").collect()}


def test_stream(spark, tmp_path):
    """On time, repeated by a second node, late within and beyond the watermark."""
    land(tmp_path / "in", "1.json", snapshot("2024-01-01T00:00:00Z", "nn1", contacts=(1,)),
         snapshot("2024-01-01T00:00:00Z", "nn2", contacts=(2,)))
    assert run(spark, tmp_path) == {}
    land(tmp_path / "in", "2.json", snapshot("2024-01-01T00:09:00Z", contacts=(3,)))
    land(tmp_path / "in", "3.json", snapshot("2024-01-01T00:05:00Z", contacts=(4,)))
    run(spark, tmp_path)
    land(tmp_path / "in", "4.json", snapshot("2024-01-01T01:00:00Z", contacts=(5,)))
    assert run(spark, tmp_path) == {"00:00": 2.0, "00:05": 4.0, "00:09": 3.0}
    land(tmp_path / "in", "5.json", snapshot("2024-01-01T00:20:00Z", contacts=(6,)))
    land(tmp_path / "in", "6.json", snapshot("2024-01-01T02:00:00Z", contacts=(7,)))
    assert run(spark, tmp_path) == {"00:00": 2.0, "00:05": 4.0, "00:09": 3.0, "01:00": 5.0}


def test_closing_adds_what_the_stream_left_open(spark, tmp_path):
    land(tmp_path / "in", "1.json", *[snapshot(f"2024-01-01T0{h}:00:00Z", contacts=(h,)) for h in range(4)])
    assert run(spark, tmp_path) == {f"0{h}:00": float(h) for h in range(3)}
    close_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "closing"))
    rows = stored_points(spark, str(tmp_path / "store"), str(tmp_path / "closing")).where("measurement = 'maxLastContact'")
    assert sorted(r.value for r in rows.collect()) == [0.0, 1.0, 2.0, 3.0]


def test_window_stream(spark, tmp_path):
    land(tmp_path / "in", "1.json", *[snapshot(f"2024-01-01T00:{m:02}:00Z", contacts=(m,)) for m in (0, 4, 5, 59)])
    query = (
        window_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("windows")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.sql("select * from windows where measurement = 'maxLastContact'").collect()
    assert {(r.window_start.minute, r.points, r.max_value) for r in rows} == {(0, 2, 4.0), (5, 1, 5.0)}


def test_snapshot_schema(spark):
    assert spark.createDataFrame([], SNAPSHOT_SCHEMA).columns == ["ts", "namespace", "node", "payload"]
