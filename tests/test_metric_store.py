"""The store of hour and day shards: late points, batches run again, closing, retention, crashes."""

import glob
import time

import pytest
from compare import spark_rows

from lakekeep.operators.metrics import dedupe_points
from lakekeep.sources.metric_store import MetricStore
from lakekeep.streaming.metrics import PointCounters, upsert_stream

SCHEMA = "ts timestamp_ntz, namespace string, measurement string, node string, value double"


def points(spark, *rows):
    """Rows (time, node, value) of one series."""
    df = spark.createDataFrame([(t, "ns", "m", node, float(v)) for t, node, v in rows], SCHEMA.replace("ts timestamp_ntz", "ts string"))
    return df.withColumn("ts", df.ts.cast("timestamp_ntz"))


def values(store):
    return sorted((str(r.ts), r.value) for r in store.read().collect())


def shards(store):
    return sorted(store.state()[1]["shards"])


def test_late_points_take_their_place(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    store.upsert(points(spark, ("2024-01-05 10:00", "nn1", 5), ("2024-01-05 11:00", "nn1", 6)))
    store.upsert(points(spark, ("2024-01-01 10:00", "nn1", 1), ("2024-01-05 10:00", "nn2", 7)))
    store.upsert(points(spark, ("2024-01-05 10:00", "nn1", 9)))
    want = [("2024-01-01 10:00:00", 1.0), ("2024-01-05 10:00:00", 7.0), ("2024-01-05 11:00:00", 6.0)]
    assert values(store) == want
    assert shards(store) == ["2024-01-01/10", "2024-01-05/10", "2024-01-05/11"]


def test_any_order_gives_what_one_pass_gives(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 4} {k % 7:02}:00", f"nn{k % 3}" if k % 5 else None, k * 37 % 11) for k in range(60)]
    store = MetricStore(spark, str(tmp_path))
    for part in (rows[40:], rows[:25], rows[10:45]):
        store.upsert(points(spark, *part))
    store.close_days("2024-01-03")
    store.upsert(points(spark, *rows))
    got = store.read().selectExpr("cast(ts as timestamp_ntz) ts", "namespace", "measurement", "value")
    assert spark_rows(got) == spark_rows(dedupe_points(points(spark, *rows)))


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    assert store.upsert(points(spark, ("2024-01-05 10:00", "nn1", 5)), "s", 0)
    number, state = store.state()
    assert not store.upsert(points(spark, ("2024-01-05 10:00", "nn9", 99)), "s", 0)
    assert store.state() == (number, state) and values(store) == [("2024-01-05 10:00:00", 5.0)]
    assert store.upsert(points(spark, ("2024-01-05 10:00", "nn2", 6)), "other", 0)
    assert values(store) == [("2024-01-05 10:00:00", 6.0)]


def test_closed_days_and_retention(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    store.upsert(points(spark, *[(f"2024-01-{d:02} {h:02}:30", "nn1", d * h) for d in (1, 2, 3, 4) for h in (3, 4)]), open_from="2024-01-02")
    assert shards(store) == ["2024-01-01/all", *[f"2024-01-{d:02}/{h:02}" for d in (2, 3, 4) for h in (3, 4)]]
    before = values(store)
    assert store.close_days("2024-01-04") == ["2024-01-02", "2024-01-03"] and store.close_days("2024-01-04") == []
    assert shards(store) == ["2024-01-01/all", "2024-01-02/all", "2024-01-03/all", "2024-01-04/03", "2024-01-04/04"]
    assert values(store) == before
    store.upsert(points(spark, ("2024-01-02 23:00", "nn1", 1)))
    assert shards(store)[1] == "2024-01-02/all" and len(values(store)) == 9
    assert store.expire("2024-01-05 00:00:00", 2) == ["2024-01-01", "2024-01-02"]
    assert shards(store) == ["2024-01-03/all", "2024-01-04/03", "2024-01-04/04"]
    late = store.read("2024-01-04 04:00:00")
    assert [str(r.ts) for r in late.collect()] == ["2024-01-04 04:30:00"]
    assert not any("hour=03" in f for f in late.inputFiles()) and not any("date=2024-01-03" in f for f in late.inputFiles())
    # Nothing that is named goes, all that was replaced does.
    assert store.vacuum() == 0 and store.vacuum(grace=-5) > 0
    assert len(values(store)) == 4
    assert len(glob.glob(f"{tmp_path}/data/version=*/date=*/hour=*")) == 3


def test_a_write_without_its_entry_is_not_read(spark, tmp_path, monkeypatch):
    store = MetricStore(spark, str(tmp_path))
    store.upsert(points(spark, ("2024-01-05 10:00", "nn1", 5)))

    def broken(*_):
        raise KeyboardInterrupt

    for step in (lambda s: s.upsert(points(spark, ("2024-01-05 10:00", "nn2", 6))), lambda s: s.close_days("2025-01-01")):
        stopped = MetricStore(spark, str(tmp_path))
        monkeypatch.setattr(stopped.ledger, "commit", broken)
        with pytest.raises(KeyboardInterrupt):
            step(stopped)
        assert values(store) == [("2024-01-05 10:00:00", 5.0)] and shards(store) == ["2024-01-05/10"]
    assert len(glob.glob(f"{tmp_path}/data/version=*")) == 3


def test_empty_store_and_other_zone(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path))
    assert store.read().count() == 0 and store.close_days("2025-01-01") == [] and store.expire("2025-01-01 00:00:00") == [] and store.vacuum() == 0
    assert store.upsert(points(spark, (None, "nn1", 5))) and shards(store) == []
    store.upsert(points(spark, ("2024-01-05 10:00", "nn1", 5)))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError):
            store.read()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_takes_late_files_and_restarts(spark, tmp_path):
    def land(name, hour, used):
        payload = '{"beans":[{"name":"Hadoop:service=NameNode,name=FSNamesystem","CapacityUsed":%d}]}' % used
        row = [(f"2024-01-{hour}", "ns", "nn1", payload)]
        df = spark.createDataFrame(row, "ts string, namespace string, node string, payload string")
        df.withColumn("ts", df.ts.cast("timestamp")).write.mode("append").json(str(tmp_path / "in"))

    def run(checkpoint="check"):
        upsert_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / checkpoint), every=None, max_files=1).awaitTermination()

    store = MetricStore(spark, str(tmp_path / "store"))
    listener = PointCounters()
    spark.streams.addListener(listener)
    land("a", "09 10:00", 9)
    run()
    land("b", "01 10:00", 1)
    run()
    # Listeners are told a little later.
    for _ in range(100):
        if sum(t["points"] for t in listener.totals.values()) == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    (told,) = listener.totals.values()
    assert (told["snapshots"], told["points"], told["latest"]) == (2, 2, "2024-01-09 10:00:00")
    want = [("2024-01-01 10:00:00", 1.0), ("2024-01-09 10:00:00", 9.0)]
    assert values(store) == want and len(store.state()[1]["batches"]) == 1
    run("another")  # A lost checkpoint: everything comes again, as another stream.
    assert values(store) == want and len(store.state()[1]["batches"]) == 2
    land("c", "02 10:00", 2)
    run("another")
    assert values(store) == [want[0], ("2024-01-02 10:00:00", 2.0), want[1]]
