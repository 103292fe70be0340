"""Usage over roots, chunking, ranges and running totals against plain Python."""

from collections import Counter

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from lakekeep.operators import split
from lakekeep.operators.compaction import plan_compaction, planned_files
from lakekeep.operators.split import byte_ranges, split_work
from lakekeep.operators.usage import dir_rollup, dir_summary, dir_summary_maps, usage, year_histogram
from lakekeep.sources.sinks import write_chunks

FILES = [("/a/f1", 1), ("/a/b/f2", 2), ("/a/b/f3", 3), ("/ab/f4", 4), ("/a/b/c/f5", 5)]
ROOTS = ["/a", "/a/b", "/a/b/f3", "/ab", "/none", "/"]


def inv(spark):
    rows = [(p, s, "2020-01-02 00:00:00", None if s == 1 else "2021-01-01 00:00:00") for p, s in FILES]
    df = spark.createDataFrame(rows, "path string, size bigint, m string, a string")
    return df.select("path", "size", F.col("m").cast("timestamp_ntz").alias("mtime"), F.col("a").cast("timestamp_ntz").alias("atime"))


WANT = {("/a", 11, 4, 3), ("/a/b", 10, 3, 2), ("/a/b/f3", 3, 1, 0), ("/ab", 4, 1, 1), ("/none", 0, 0, 0), ("/", 15, 5, 5)}


@pytest.mark.parametrize("more", [0, 11, 495])
@pytest.mark.parametrize("table", [False, True])
@pytest.mark.parametrize("end", ["", "/", "//"])
def test_rollup(spark, more, table, end):
    """The same answer for 6, 17 and 501 roots, as a list or a table, with or without slashes at the end."""
    roots = [r + end for r in ROOTS] + [f"/no/{i}" for i in range(more)]
    if table:
        roots = spark.createDataFrame([(r,) for r in roots], "root string")
    rows = dir_rollup(inv(spark), roots, file_roots=True).where(~F.col("root").startswith("/no/"))
    assert {(r.root, r.bytes, r.files, r.dirs) for r in rows.collect()} == WANT


def test_listed_folders_count_once(spark):
    listed = spark.createDataFrame(
        [("/a", "drwxr-xr-x", 0), ("/a/e", "drwxr-xr-x", 0), ("/a/b/f", "-rw-r--r--", 7)],
        "path string, permission string, size bigint",
    )
    assert spark_rows(dir_rollup(listed, ["/a"]).select("root", "bytes", "files", "dirs")) == {(7, 3, 1, "/a"): 1}


def test_year_histogram(spark):
    rows = year_histogram(inv(spark), ["/a"], "atime").collect()
    assert {(r.year, r.files, r.bytes) for r in rows} == {("1970", 1, 1), ("2021", 3, 10)}


def test_summary_forms_agree(spark):
    long = dir_summary(inv(spark), ROOTS, "2021-01-15 00:00:00").collect()
    heat = {(r.root, r.key): r.files for r in long if r.dimension == "temperature"}
    assert heat[("/a", "HOT")] == 3 and heat[("/a", "COLD")] == 1
    maps = {r.root: r for r in dir_summary_maps(inv(spark), ROOTS, "2021-01-15 00:00:00").collect()}
    assert maps["/a"].files_per_temperature == {"HOT": 3, "COLD": 1}
    assert maps["/a"].bytes_per_atime_year == {"1970": 1, "2021": 10}
    assert maps["/none"].files == 0 and maps["/none"].files_per_temperature is None


def test_usage_of_nothing_is_zero(spark):
    assert usage(inv(spark), "/nowhere/*").first().asDict() == {"bytes": 0, "files": 0}
    assert usage(inv(spark), "/a/*").first().asDict() == {"bytes": 1, "files": 1}


@pytest.mark.parametrize("rows,n,mode,chunks", [(49, 25, "floor", 49), (49, 25, "even", 25), (10, 3, "floor", 4), (2, 50, "floor", 2)])
def test_chunks(spark, rows, n, mode, chunks):
    df = spark.range(rows).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    out = split_work(df, n, mode=mode).collect()
    assert sorted(r.idx for r in out) == list(range(rows))
    assert len({r.chunk for r in out}) == chunks
    assert {r.path for r in out} == {r.path for r in df.collect()}


def test_copies_of_one_row_are_spread_over_chunks(spark):
    one = spark.range(4000).select(F.lit("/hot").alias("path"), F.lit(1).alias("v"))
    near = spark.range(500).select(F.lit("/hot").alias("path"), F.col("id").cast("int").alias("v"))
    cold = spark.range(500).select(F.concat(F.lit("/c"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("v"))
    df = one.unionByName(near).unionByName(cold)
    out = split_work(df, 10)
    rows = out.collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    assert Counter(r.chunk for r in rows) == {i: 500 for i in range(10)}
    assert spark_rows(out.drop("idx", "chunk")) == spark_rows(df)


def test_chunks_are_the_same_for_every_layout(spark):
    df = spark.range(1000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    assert spark_rows(split_work(df.repartition(3), 7)) == spark_rows(split_work(df.repartition(11), 7))


def test_rows_of_a_split_meet_in_one_shuffle(spark, tmp_path):
    """Rows are dealt to tasks by their index once, and are not shuffled again to be written by chunk."""
    path = str(tmp_path / "rows")
    spark.range(3000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path")).write.parquet(path)
    out = split_work(spark.read.parquet(path), 7)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    write_chunks(out, str(tmp_path / "chunks"))
    back = spark.read.schema(out.schema).parquet(str(tmp_path / "chunks"))
    assert spark_rows(back) == spark_rows(out)
    # A chunk is not strewn over many files.
    assert len(list((tmp_path / "chunks").glob("chunk=*/*.parquet"))) <= 2 * 7


def test_buckets_full_of_copies_give_the_same_split(spark, monkeypatch):
    """Copies are folded before the shuffle where they fill a bucket; chunks are the same either way."""
    df = spark.range(500).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    df = df.unionByName(spark.range(900).select(F.lit("/hot").alias("path"))).unionByName(spark.range(3).select(F.lit(None).cast("string").alias("path")))
    plain = spark_rows(split_work(df, 7))
    monkeypatch.setattr(split, "BUCKET_ROWS", 10)
    monkeypatch.setattr(split, "COPY_BLOCK", 64)
    monkeypatch.setattr(split, "TASK_ROWS", 100)
    assert spark_rows(split_work(df, 7)) == plain


def test_byte_ranges(spark):
    df = spark.createDataFrame([("a", 0), ("b", 10), ("c", 11), ("d", 3)], "k string, n bigint")
    got = sorted((r.k, r.start, r["bytes"]) for r in byte_ranges(df, "n", 5).collect())
    assert got == [("b", 0, 5), ("b", 5, 5), ("c", 0, 5), ("c", 5, 5), ("c", 10, 1), ("d", 0, 3)]


def test_bins_of_one_large_folder(spark):
    rows = [(f"/big/{i:05}", i % 97) for i in range(3000)] + [(f"/s{i}/f", i) for i in range(20)]
    df = spark.createDataFrame(rows, "path string, size bigint")
    want, before = {}, {}
    for path, size in sorted(rows):
        folder = path.rsplit("/", 1)[0]
        want[path] = before.get(folder, 0) // 1000
        before[folder] = before.get(folder, 0) + size
    assert {r.path: r.bin for r in plan_compaction(df, 1000).collect()} == want


def test_bins_keep_rows_without_a_path(spark):
    df = spark.createDataFrame([("/a/f", 5), (None, 7), (None, 7), ("/a/f", 5)], "path string, size bigint")
    out = plan_compaction(df, 10).collect()
    assert sorted((r.path or "", r.bin) for r in out) == [("", 0), ("", 0), ("/a/f", 0), ("/a/f", 0)]


def test_planned_files(spark):
    df = spark.createDataFrame([("/a/1", 5), ("/a/2", 5), ("/a/3", 5), ("/b/1", 1)], "path string, size bigint")
    got = {r.dir: (r.files_before, r.files_after, r.bytes) for r in planned_files(df, 10).collect()}
    assert got == {"/a": (3, 2, 15), "/b": (1, 1, 1)}


def test_order_of_chunks_does_not_depend_on_copies(spark):
    df = spark.range(60).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"))
    copies = df.unionByName(spark.range(2000).select(F.lit("/p/7").alias("path")))
    few = [r.path for r in split_work(df, 5).orderBy("idx").collect()]
    many = [r.path for r in split_work(copies, 5).orderBy("idx").collect()]
    assert [p for p in dict.fromkeys(many)] == few
