"""Usage kept up by changes, usage of all partitions, observed counters."""

import random

import pytest
from compare import spark_rows
from pyspark.sql import Observation
from test_changes import change_rows, target

from lakekeep.operators.stored_usage import folder_classes, signed_changes, summary_from, updated_classes
from lakekeep.operators.usage import dir_summary, location_usage
from lakekeep.plans.actions import COUNTERS, counters, observed, outcomes
from lakekeep.sources.files import partition_locations

SCHEMA = "path string, is_file boolean, size bigint, mtime string, atime string"
AS_OF = "2024-01-31 00:00:00"
ROOTS = ["/", "/a", "/a/b/", "/gone", "/c"]


def inv(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"mtime": df.mtime.cast("timestamp_ntz"), "atime": df.atime.cast("timestamp_ntz")})


def some(rng, n, folders):
    out = []
    for k in range(n):
        at = rng.choice([None, "2024-01-01 00:00", "2023-08-04 00:00", "2023-08-03 23:59", "2024-01-20 12:00", "2020-05-05 05:05"])
        out.append((f"{rng.choice(folders)}/f{k}", True, rng.choice([None, 0, 5, 1000]), rng.choice(["2023-12-31 23:59", "2024-01-01 00:00"]), at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_equal_a_new_summary(spark, seed):
    rng = random.Random(seed)
    old = some(rng, 80, ["/a", "/a/b", "/a/b/c", "/gone/x"]) + [("/empty", False, 0, "2024-01-01 00:00", None), ("/a", False, 0, "2024-01-01 00:00", None)]
    new = [r for r in old if "/gone" not in r[0] and r[0] != "/empty" and rng.random() < 0.7] + some(rng, 30, ["/c", "/a/b"])
    new += [("/c/listed", False, 0, "2024-01-01 00:00", None), (new[0][0], True, 77, "2025-01-01 00:00", "2024-01-30 00:00")]
    new = list({r[0]: r for r in new}.values())
    old, new = inv(spark, old), inv(spark, new)
    classes = folder_classes(old)
    assert spark_rows(summary_from(classes, ROOTS, AS_OF)) == spark_rows(dir_summary(old, ROOTS, AS_OF))
    after = updated_classes(classes, signed_changes(old, new))
    assert spark_rows(summary_from(after, ROOTS, AS_OF)) == spark_rows(dir_summary(new, ROOTS, AS_OF))
    assert spark_rows(after) == spark_rows(folder_classes(new))
    # The same table serves a later day.
    assert spark_rows(summary_from(after, ROOTS, "2024-03-01 00:00:00")) == spark_rows(dir_summary(new, ROOTS, "2024-03-01 00:00:00"))


def test_no_change_and_hours(spark):
    tree = inv(spark, some(random.Random(3), 20, ["/a"]))
    assert signed_changes(tree, tree).isEmpty()
    classes = folder_classes(tree)
    assert spark_rows(updated_classes(classes, signed_changes(tree, tree))) == spark_rows(classes)
    with pytest.raises(ValueError):
        summary_from(classes, ROOTS, "2024-01-31 10:00:00")


def test_nested_outside_and_shared_locations(spark):
    files = spark.createDataFrame(
        [("/t/p=1/f", 1), ("/t/p=1/sub/f", 10), ("/t/p=1/sub/deep/f", 100), ("/t/p=10/f", 1000), ("/x/y/f", 5), ("/none/f", 7), ("/t/p=1x/f", 9)],
        "path string, size bigint",
    )
    at = [("1", "/t/p=1/"), ("2", "file:/t/p=1/sub"), ("3", "hdfs://nn/x"), ("4", "/x"), ("5", "/t/p=2"), (None, "/t/p=10")]
    got = {(r.p, r.location): (r.bytes, r.files) for r in location_usage(files, spark.createDataFrame(at, "p string, location string")).collect()}
    assert got == {
        ("1", "/t/p=1/"): (1, 1), ("2", "file:/t/p=1/sub"): (110, 2), ("3", "hdfs://nn/x"): (5, 1), ("4", "/x"): (5, 1),
        ("5", "/t/p=2"): (0, 0), (None, "/t/p=10"): (1000, 1), (None, None): (16, 2),
    }
    none = location_usage(files, spark.createDataFrame([], "p string, location string")).collect()
    assert [(r.bytes, r.files) for r in none] == [(1132, 7)]


def test_locations_come_from_the_catalog(spark, tmp_path):
    spark.sql("drop table if exists located")
    spark.sql(f"create table located (v int, p string, q int) using parquet partitioned by (p, q) location '{tmp_path}/t'")
    spark.sql(f"alter table located add partition (p='a', q=1) location '{tmp_path}/t/p=a/q=1' partition (p='a', q=2) location '{tmp_path}/t/p=a/q=1/in' "
              f"partition (p=null, q=3) location '{tmp_path}/else where'")
    got = {(r.p, r.q): r.location.removeprefix("file:").replace("%20", " ") for r in partition_locations(spark, "located").collect()}
    assert got == {("a", "1"): f"{tmp_path}/t/p=a/q=1", ("a", "2"): f"{tmp_path}/t/p=a/q=1/in", (None, "3"): f"{tmp_path}/else where"}
    spark.sql("drop table located")


def test_observed_counters_come_with_the_job(spark):
    lines = outcomes(change_rows(spark), target(spark))
    observation = Observation("test")
    observed(lines, observation).write.format("noop").mode("overwrite").save()
    assert observation.get == counters(lines).first().asDict() and tuple(observation.get) == COUNTERS
