"""Compaction, trash and partition registration on real folders."""

import os

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from lakekeep.operators.compaction import compact_text, content_digest, line_count, packed_scan, swap_compacted
from lakekeep.operators.metrics import retain
from lakekeep.operators.partitions import found_partitions, missing_partitions, register_partitions, registered_partitions
from lakekeep.operators.quarantine import (
    checked_day, move_matching, move_tree, purge, purge_trash, quarantine, quarantine_partition, read_trash, write_trash,
)
from lakekeep.operators.usage import table_usage
from lakekeep.operators.verify import verify
from lakekeep.plans.storage_queries import partitions_missing
from lakekeep.session import pinned, scratch, shared_root
from lakekeep.sources.files import file_digests, read_text_tree, scan_files, scan_partition
from lakekeep.sources.sinks import TEXT_CODECS, codec_of, expire_metrics, write_failures, write_metrics


def text_tree(tmp_path, files=40):
    for i in range(files):
        folder = tmp_path / "src" / f"d{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.txt").write_text("".join(f"line {i} {j}\n" for j in range(20)) + "same\n")
    return str(tmp_path / "src")


@pytest.mark.parametrize("tier", ["HOT", "warm", "COLD"])
def test_compaction_keeps_all_lines(spark, tmp_path, tier):
    src, dst = text_tree(tmp_path), str(tmp_path / "dst")
    report = compact_text(spark, src, dst, tier)
    assert report.lines == 40 * 21
    assert spark_rows(read_text_tree(spark, dst)) == spark_rows(read_text_tree(spark, src))
    parts = [n for n in os.listdir(dst) if not n.startswith(".")]
    assert len(parts) == 1 and "_SUCCESS" not in parts


def test_packing_follows_the_target_size(spark, tmp_path):
    src = text_tree(tmp_path)
    total = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(src) for f in fs)
    parts = packed_scan(spark, src, total // 4, None).rdd.getNumPartitions()
    assert 4 <= parts <= 8
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"


def test_unknown_tier():
    with pytest.raises(ValueError):
        codec_of("ICE", TEXT_CODECS)


def test_digest_sees_changes_but_no_order(spark):
    def digest(*lines):
        return content_digest(spark.createDataFrame([(x,) for x in lines], "value string")).first()

    assert digest("a", "b", "b") == digest("b", "a", "b")
    assert digest("a", "b", "b") != digest("a", "a", "b")
    assert line_count(spark.createDataFrame([], "value string")).first().lines == 0


def test_quarantine_parts_every_row(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    kept, gone = quarantine(df, F.col("v") > 3, "20240101")
    assert spark_rows(kept) == {(1,): 1, (None,): 1}
    assert spark_rows(gone) == {("20240101", 5): 1}


def test_days_are_checked():
    for bad in ("2024010", "2024-01-01", "", "../../..", "20240101/x"):
        with pytest.raises(ValueError):
            checked_day(bad)


def test_purge_keeps_rows_without_a_day(spark):
    trash = spark.createDataFrame([(1, "20240101"), (2, "20240102"), (3, None)], "v int, trash_day string")
    assert sorted(r.v for r in purge(trash, "20240101").collect()) == [2, 3]


def test_purge_trash(spark, tmp_path):
    root = str(tmp_path / "trash")
    df = spark.createDataFrame([(1,), (5,)], "v int")
    write_trash(quarantine(df, F.col("v") > 3, "20240101")[1], root, "/tables/t")
    write_trash(quarantine(df, F.col("v") < 3, "20240102")[1], root, "/tables/t")
    moved = move_matching(spark, f"{text_tree(tmp_path)}/d[01]", root, "20240101")
    assert len(moved) == 2 and all(os.path.exists(m) for m in moved)
    assert spark_rows(read_trash(spark, root, "/tables/t", df.schema)) == {("20240101", 5): 1, ("20240102", 1): 1}
    assert purge_trash(spark, root, "20240101")
    assert not purge_trash(spark, root, "20240101") and not any(os.path.exists(m) for m in moved)
    assert spark_rows(read_trash(spark, root, "/tables/t", df.schema)) == {("20240102", 1): 1}
    for unsafe in ("", "/", "hdfs://"):
        with pytest.raises(ValueError):
            purge_trash(spark, unsafe, "20240101")


def test_move_tree(spark, tmp_path):
    src = text_tree(tmp_path, 3)
    goal = move_tree(spark, src, str(tmp_path / "trash"), "20240101")
    assert goal.endswith(src) and not os.path.exists(src)
    assert read_text_tree(spark, goal).count() == 63
    text_tree(tmp_path, 1)
    with pytest.raises(FileExistsError):
        move_tree(spark, src, str(tmp_path / "trash"), "20240101")
    with pytest.raises(ValueError):
        move_tree(spark, "/", str(tmp_path / "trash"), "20240101")


def test_scan_files(spark, tmp_path):
    src = text_tree(tmp_path, 6)
    files = scan_files(spark, f"{src}/d1/*").collect()
    assert sorted(r.path for r in files) == [f"{src}/d1/f1.txt", f"{src}/d1/f4.txt"]
    assert all(r.size == os.path.getsize(r.path) for r in files)
    assert scan_files(spark, src, recursive=True).count() == 6


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"{i % 4:02}") for i in range(40)], "v int, h string")
    rows.write.partitionBy("h").parquet(folder)
    spark.sql(f"create table ext (v int, h string) using parquet partitioned by (h) location '{folder}'")
    yield "ext", folder
    spark.sql("drop table ext")


def found(spark, folder, *values):
    return spark.createDataFrame([(v, f"{folder}/h={v}") for v in values], "h string, location string")


def test_registration(spark, table):
    name, folder = table
    assert register_partitions(spark, name, found(spark, folder, "00", "01")).added == 2
    # A known partition keeps its place even when found elsewhere.
    moved = found(spark, folder, "02").unionByName(spark.createDataFrame([("00", "/nowhere")], "h string, location string"))
    assert register_partitions(spark, name, moved).added == 1
    assert sorted(r.h for r in registered_partitions(spark, name).collect()) == ["00", "01", "02"]
    assert spark.table(name).count() == 30
    rows = scan_partition(spark, name, ["01"])
    assert rows.count() == 10 and rows.where(~F.col("file_path").contains("h=01")).count() == 0
    with pytest.raises(ValueError):
        scan_partition(spark, name, ["01", "02"])


def test_quarantined_partition_takes_its_files_along(spark, table, tmp_path):
    name, folder = table
    register_partitions(spark, name, found(spark, folder, "00", "01"))
    goal = quarantine_partition(spark, name, ["00"], str(tmp_path / "trash"), "20240101")
    assert [r.h for r in registered_partitions(spark, name).collect()] == ["01"]
    assert not os.path.exists(f"{folder}/h=00") and spark.read.parquet(goal).count() == 10
    listed = found_partitions(scan_files(spark, f"{folder}/h=*/*"), ["h"])
    register_partitions(spark, name, listed)
    assert sorted(r.h for r in registered_partitions(spark, name).collect()) == ["01", "02", "03"]
    # After a crash between the move and the catalog's change.
    spark.sql(f"alter table {name} add partition (h='00') location '{folder}/h=00'")
    assert quarantine_partition(spark, name, ["00"], str(tmp_path / "trash"), "20240101") == goal
    assert purge_trash(spark, str(tmp_path / "trash"), "20240101") and not os.path.exists(goal)


@pytest.mark.parametrize("kind,values", [("int", ["05", "6"]), ("string", ["a%3Ab", "c d", "x+y"]), ("date", ["2024-01-05"])])
def test_registered_values_are_typed_and_unescaped(spark, tmp_path, kind, values):
    folder = str(tmp_path / "typed")
    for v in [*values, "__HIVE_DEFAULT_PARTITION__"]:
        spark.range(3).select(F.col("id").cast("int").alias("v")).write.parquet(f"{folder}/k={v}/sub")
    spark.sql(f"create table typed (v int, k {kind}) using parquet partitioned by (k) location '{folder}'")
    try:
        inv = scan_files(spark, f"{folder}", recursive=True)
        first = register_partitions(spark, "typed", found_partitions(inv, ["k"]))
        assert first.added == len(values) + 1 and first.conflicts.count() == 0
        assert register_partitions(spark, "typed", found_partitions(inv, ["k"])).added == 0
        known = registered_partitions(spark, "typed")
        assert missing_partitions(found_partitions(inv, ["k"]), known, ["k"]).count() == 0
        want = {None, *(v.replace("%3A", ":").lstrip("0") if kind != "date" else v for v in values)}
        assert {None if r.k is None else str(r.k) for r in known.collect()} == want
        extra = found_partitions(inv, ["k"]).limit(0).unionByName(
            spark.createDataFrame([("7", "/x/k=7"), ("7", "/y/k=7")], "k string, location string")
        ) if kind == "int" else None
        if extra is not None:
            told = register_partitions(spark, "typed", extra)
            assert told.added == 0 and [sorted(r.locations) for r in told.conflicts.collect()] == [["/x/k=7", "/y/k=7"]]
    finally:
        spark.sql("drop table typed")


def test_usage_of_a_partition(spark, table):
    name, folder = table
    register_partitions(spark, name, found(spark, folder, "00", "01"))
    size = sum(os.path.getsize(f"{folder}/h=01/{n}") for n in os.listdir(f"{folder}/h=01") if n.endswith(".parquet"))
    assert table_usage(spark, name, "01 / ").first().bytes == size
    assert table_usage(spark, name, ["03"]).first().asDict() == {"bytes": 0, "files": 0}
    with pytest.raises(ValueError):
        table_usage(spark, name, "01 / 02")


def test_swap_after_compaction(spark, tmp_path):
    src, made, out, trash = text_tree(tmp_path), str(tmp_path / "made"), str(tmp_path / "out"), str(tmp_path / "trash")
    before = spark_rows(read_text_tree(spark, src))
    compact_text(spark, src, made, "WARM")
    names = swap_compacted(spark, src, made, out, "p-", trash, "20240101")
    assert names == swap_compacted(spark, src, made, out, "p-", trash, "20240101")
    assert not os.path.exists(src) and spark_rows(read_text_tree(spark, out)) == before
    assert spark_rows(read_text_tree(spark, f"{trash}/20240101{src}")) == before


def test_tiny_files_are_not_one_task(spark, tmp_path):
    for i in range(300):
        (tmp_path / "tiny").mkdir(exist_ok=True)
        (tmp_path / "tiny" / f"f{i}").write_text("" if i % 2 else "x\n")
    assert packed_scan(spark, str(tmp_path / "tiny"), 32 << 20, None).rdd.getNumPartitions() > 3


def test_digests_of_files(spark, tmp_path):
    src = text_tree(tmp_path, 6)
    one = file_digests(read_text_tree(spark, src))
    assert one.count() == 6 and one.select("digest").distinct().count() == 6
    (tmp_path / "src" / "d0" / "f0.txt").write_text("other\n")
    two = file_digests(read_text_tree(spark, src))
    changed = verify(one.cache(), two).where("status = 'CONTENT'").collect()
    assert len(changed) <= 1


def test_scratch_is_deleted(spark, tmp_path):
    with scratch(spark):
        kept = pinned(spark.range(5))
        paths = [f.removeprefix("file:").removeprefix("//") for f in kept.inputFiles()]
        assert all(os.path.exists(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)


def test_expired_days_go(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(d) ts, 'n' namespace, 'm' measurement, 1.0D value from (select explode(sequence(0, 9)) d)")
    write_metrics(rows, str(tmp_path / "store"))
    assert expire_metrics(spark, str(tmp_path / "store"), "2024-01-10 06:00:00", 5) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    held = spark.read.schema("ts timestamp_ntz, date string").parquet(str(tmp_path / "store"))
    assert held.count() == 6
    plan = retain(held, "2024-01-10 06:00:00", 5)
    assert plan.count() == 6 and "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().toString()


def test_managed_tables_are_refused(spark, tmp_path):
    spark.sql("drop table if exists managed")
    spark.sql("create table managed (v int, h string) using parquet partitioned by (h)")
    try:
        with pytest.raises(ValueError):
            register_partitions(spark, "managed", found(spark, "/x", "00"))
        with pytest.raises(ValueError):
            quarantine_partition(spark, "managed", ["00"], str(tmp_path), "20240101")
    finally:
        spark.sql("drop table managed")


def test_missing_partitions(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "1"), ("x", "2")], "p string, q string")
    b = spark.createDataFrame([("x", "1")], "p string, q string")
    assert spark_rows(missing_partitions(a, b, ["p", "q"])) == {("x", "2"): 1}


def test_a_partition_counts_by_any_file_of_the_older_tree(spark, tmp_path):
    """A late file of low priority is a file; only the partition that came after the older tree is missing."""
    orders = [(1, "F", "1997-05-01"), (2, "P", "2001-05-01")]
    day = F.col("day").cast("timestamp_ntz")
    made = spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, day string").select(
        "o_orderkey", F.lit(1).cast("long").alias("o_custkey"), "o_orderstatus", F.lit(1.0).alias("o_totalprice"),
        day.alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"),
    )
    made.write.parquet(str(tmp_path / "orders.parquet"))
    made.select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_quantity"),
        F.lit("N").alias("l_returnflag"), F.col("o_orderdate").alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert spark_rows(partitions_missing(spark, str(tmp_path))) == {("P", "2001"): 1}


def test_failures_are_sorted_by_chunk_and_line(spark, tmp_path):
    rows = [(i % 3, f"line {i:03}", None if i % 5 == 0 else "unknown_op") for i in range(100)]
    write_failures(spark.createDataFrame(rows, "chunk int, raw string, reason string"), str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.count() == 80
    ordered = stored.select("chunk", "raw", F.input_file_name().alias("file")).collect()
    by_file = {}
    for r in ordered:
        by_file.setdefault(r.file, []).append((r.chunk, r.raw))
    assert all(v == sorted(v) for v in by_file.values())


class FakeSession:
    """Just enough of a session to ask where its scratch folder is."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = self
        self.master, self.folder, self.applicationId = master, folder, f"app-{master}"

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder_comes_from_the_session():
    assert shared_root(FakeSession("spark://m:7077", "hdfs://nn/cp/")) == "hdfs://nn/cp"
    for master in ("spark://m:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_root(FakeSession(master))
    local = FakeSession("local[2]")
    assert shared_root(local) == shared_root(local) and os.path.isdir(shared_root(local))
