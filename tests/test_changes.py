"""Diff, plans, application and verification on small trees, and their laws."""

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from lakekeep.operators.diff import snapshot_diff
from lakekeep.operators.keyed import last_wins, match_unique
from lakekeep.operators.verify import verify
from lakekeep.plans.actions import (
    check_job, counters, delete_outcomes, delete_rows, outcomes, plan_actions, plan_source_delete,
)
from lakekeep.plans.apply import apply_changes
from lakekeep.plans.inputs import inventory
from lakekeep.plans.sync import sync_diff, sync_full
from lakekeep.sources.listing import parse_changes, parse_listing

T1, T2 = "2020-01-01 10:00", "2020-01-01 10:01"


def listing(spark, *rows):
    """Rows (path, size, time[, permission]) as a parsed listing with reading positions."""
    text = [
        (f"{r[3] if len(r) > 3 else '-rw-r--r--'} 3 u g {r[1]} {r[2]} {r[0]}", i) for i, r in enumerate(rows)
    ]
    return parse_listing(spark.createDataFrame(text, "raw string, pos int"))[0]


def ops(df):
    return sorted((r.op, r.path) for r in df.collect())


def pair(spark):
    old = listing(spark, ("/a/f1", 1, T1), ("/a/f2", 2, T1), ("/a/f2", 3, T1), ("/a/f4", 4, T1))
    new = listing(spark, ("/a/f1", 1, T2), ("/a/f2", 3, T1), ("/a/f5", 5, T1))
    return old, new


def test_diff(spark):
    assert ops(snapshot_diff(*pair(spark))) == [("ADD", "/a/f5"), ("DELETE", "/a/f4"), ("UPDATE", "/a/f1")]
    assert ops(snapshot_diff(*pair(spark), ignore_time=True)) == [("ADD", "/a/f5"), ("DELETE", "/a/f4")]


def test_diff_of_a_tree_with_itself_is_empty(spark):
    old, _ = pair(spark)
    kept = last_wins(old, ["path"], ["pos"])
    assert snapshot_diff(kept, kept).count() == 0


def test_repeated_new_rows_are_all_compared(spark):
    old, _ = pair(spark)
    new = listing(spark, *[("/a/f1", 1, T2)] * 7, *[("/a/f9", i, T1) for i in range(5)], ("/a/f2", 3, T1))
    want = sorted([("UPDATE", "/a/f1")] * 7 + [("ADD", "/a/f9")] * 5 + [("DELETE", "/a/f4")])
    assert ops(snapshot_diff(old, new)) == want


def test_counts_of_a_regular_pair(spark):
    """Every tenth file missing, added, grown or touched."""
    inv = inventory(spark, "/root/testdata/sf0.01")
    old = inv.where("k % 10 <> 7")
    size = F.when(F.expr("k % 10 = 5"), F.col("size") + 1).otherwise(F.col("size"))
    mtime = F.when(F.expr("k % 10 = 6"), F.col("mtime") + F.expr("interval 1 day")).otherwise(F.col("mtime"))
    new = inv.where("k % 10 <> 3").withColumn("size", size).withColumn("mtime", mtime)

    def counts(df):
        return {r.op: r["count"] for r in df.groupBy("op").count().collect()}

    assert counts(snapshot_diff(old, new)) == {"ADD": 1500, "DELETE": 1500, "UPDATE": 3000}
    changes = snapshot_diff(old, new, ignore_time=True)
    assert counts(changes) == {"ADD": 1500, "DELETE": 1500, "UPDATE": 1500}
    applied = apply_changes(old, new, snapshot_diff(old, new))
    assert spark_rows(applied.snapshot) == spark_rows(new)
    assert applied.failures.count() == 0


def test_a_key_with_most_rows_of_new(spark):
    """One path owns most of the new listing; every row of it is compared, and no job starts before the result is asked for."""
    old = listing(spark, ("/hot", 1, T1), ("/gone", 1, T1), ("/same", 1, T1))
    hot = spark.range(3000).select(F.lit("/hot").alias("path"), (F.col("id") % 3).alias("size"))
    new = listing(spark, ("/new", 1, T1), ("/same", 1, T1)).unionByName(
        listing(spark, ("/hot", 1, T1)).drop("size").join(hot, "path").select(*old.columns)
    )
    context = spark.sparkContext
    context.setJobGroup("diff", "nothing is run by building the diff")
    changes = snapshot_diff(old, new)
    assert not context.statusTracker().getJobIdsForGroup("diff")
    context.setJobGroup("none", "")
    got = {(r.op, r.path): r["count"] for r in changes.groupBy("op", "path").count().collect()}
    assert got == {("ADD", "/new"): 1, ("DELETE", "/gone"): 1, ("UPDATE", "/hot"): 2000}


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_match_unique_keeps_null_keys_apart(spark, how):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 5), (None, 6)], "k int, w int")
    got = {r.v for r in match_unique(left, right, ["k"], how).collect()}
    assert got == {"left": {"a", "b", "c"}, "left_semi": {"a"}, "left_anti": {"b", "c"}}[how]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, o int, v string")
    assert spark_rows(last_wins(df, ["k"], ["o"])) == {("a", 3, "y"): 1, ("b", 1, None): 1}


CHANGES = [
    ("ADD", "/n/f", "-"), ("ADD", "/n", "d"), ("ADD", "/t/d", "d"), ("UPDATE", "/t/f", "-"), ("UPDATE", "/t/d", "d"),
    ("UPDATE", "/t/f2", "d"), ("DELETE", "/t/f", "-"), ("DELETE", "/gone", "-"), ("UPDATE", "/t/d", "-"),
    ("MOVE", "/n/f", "-"), ("ADD", "/a/.Trash/f", "-"),
]


def change_rows(spark):
    text = [(f"{op} {kind}rwxr-xr-x 3 u g 1 {T1} {path}",) for op, path, kind in CHANGES]
    return parse_changes(spark.createDataFrame(text + [("too short",)], "raw string"))


def target(spark):
    return listing(spark, ("/t/f", 1, T1), ("/t/f2", 1, T1), ("/t/d", 0, T1, "drwxr-xr-x"), ("/t/d/x", 1, T1))


def test_plan_actions(spark):
    plan = plan_actions(outcomes(change_rows(spark), target(spark)), "/dst")
    got = {}
    for r in plan.orderBy("seq").collect():
        got.setdefault((r.op, r.path), []).append(r.action)
    attrs = ["CHOWN", "CHMOD", "TIMES"]
    assert got == {
        ("ADD", "/n/f"): ["COPY", *attrs],
        ("ADD", "/n"): ["MKDIR", *attrs],
        ("ADD", "/t/d"): attrs,
        ("UPDATE", "/t/f"): ["DELETE", "COPY", *attrs],
        ("UPDATE", "/t/d"): ["FAIL", *attrs],
        ("UPDATE", "/t/f2"): ["DELETE", "MKDIR", *attrs],
        ("DELETE", "/t/f"): ["DELETE"],
        ("MOVE", "/n/f"): ["FAIL"],
        ("ADD", "/a/.Trash/f"): ["SKIP"],
    }


def test_counters(spark):
    row = counters(outcomes(change_rows(spark), target(spark))).first().asDict()
    assert row == {
        "total": 12, "succ": 9, "fail": 2, "invalid": 1, "added": 3, "deleted": 2, "updated": 3,
        "mkdir": 4, "copied": 2, "reduced": 2,
    }
    assert row["total"] == row["succ"] + row["fail"] + row["invalid"]


def test_jobs(spark):
    with pytest.raises(ValueError):
        check_job("rename")
    with pytest.raises(ValueError):
        outcomes(change_rows(spark), target(spark), "delete")


def test_failed_changes_keep_the_target(spark):
    source = listing(spark, ("/t/d", 9, T1), ("/n/f", 1, T1))
    changes = change_rows(spark).where("path in ('/t/f', '/t/d', '/n/f') and op in ('UPDATE', 'ADD')")
    kept = apply_changes(target(spark).drop("pos"), source, changes.where("permission like '-%'"), tree=True)
    assert sorted((r.path, r.reason) for r in kept.failures.collect()) == [
        ("/t/d", "kind_conflict"), ("/t/f", "source_missing"),
    ]
    assert sorted(r.path for r in kept.snapshot.collect()) == ["/n/f", "/t/d", "/t/d/x", "/t/f", "/t/f2"]


def test_deleting_a_folder_takes_what_is_below(spark):
    gone = parse_changes(spark.createDataFrame([(f"DELETE drwxr-xr-x - u g 0 {T1} /t/d",)], "raw string"))
    none = target(spark).where("false")
    done = apply_changes(target(spark).drop("pos"), none, gone, tree=True)
    assert sorted(r.path for r in done.snapshot.collect()) == ["/t/f", "/t/f2"]


def test_changes_of_one_key_take_the_last(spark):
    text = [(f"{op} -rw-r--r-- 3 u g 1 {T1} /t/f", i) for i, op in enumerate(["DELETE", "ADD", "DELETE"])]
    changes = parse_changes(spark.createDataFrame(text, "raw string, pos int"))
    done = apply_changes(target(spark).drop("pos"), target(spark), changes)
    assert "/t/f" not in {r.path for r in done.snapshot.collect()}


def test_source_delete(spark):
    src = listing(
        spark, ("/user/ann", 0, T1, "drwxr-xr-x"), ("/user/ann/f", 1, T1), ("/user/ann/d", 0, T1, "drwxr-xr-x"),
        ("/user/ann/d/x/y", 1, T1), ("/user/ann/dd", 1, T1), ("/user/bob/.Trash", 0, T1, "drwxr-xr-x"),
    )
    listed = listing(spark, *[(p, 1, T1) for p in (
        "/user/ann", "/user/ann/f", "/user/ann/f", "/user/ann/d", "/a/gone", "/user/bob/.Trash")])
    flat = plan_source_delete(listed, src)
    assert [r.path for r in flat.collect()] == ["/user/ann/f"]
    deep = plan_source_delete(listed, src, recursive=True)
    assert sorted(r.path for r in deep.collect()) == ["/user/ann/d", "/user/ann/f"]
    left = sorted(r.path for r in delete_rows(src, deep, True).collect())
    assert left == ["/user/ann", "/user/ann/dd", "/user/bob/.Trash"]
    assert delete_rows(src, flat).count() == 5


def test_verify(spark):
    src = spark.createDataFrame(
        [("/a", "1", True), ("/b", "1", True), ("/c", "1", True), ("/d", None, False), ("/e", "1", True),
         ("/m", "1", True), ("/m", "2", True), ("/x/.Trash/f", "1", True)], "path string, digest string, is_file boolean")
    dst = spark.createDataFrame(
        [("/a", "1", True), ("/b", "2", True), ("/d", None, False), ("/e", None, False), ("/z", "1", True),
         ("/m", "2", True), ("/m", "1", True)], "path string, digest string, is_file boolean")
    want = {"/a": "MATCH", "/b": "CONTENT", "/c": "NO_TARGET", "/d": "MATCH", "/e": "KIND", "/m": "MATCH", "/z": "NO_SOURCE"}
    assert {r.path: r.status for r in verify(src, dst).collect()} == want
    asked = spark.createDataFrame([("ADD", "/a"), ("UPDATE", "/q"), ("DELETE", "/b"), ("ADD", "/a")], "op string, path string")
    assert spark_rows(verify(src, dst, asked)) == {("/a", "MATCH"): 1, ("/q", "NO_BOTH"): 1}


def test_an_unknown_digest_is_no_match(spark):
    rows = spark.createDataFrame([("/a", None, True), ("/b", "1", True), ("/d", None, False)], "path string, digest string, is_file boolean")
    assert {r.path: r.status for r in verify(rows, rows).collect()} == {"/a": "UNKNOWN", "/b": "MATCH", "/d": "MATCH"}


def test_counters_follow_the_job(spark):
    lines, held = change_rows(spark), target(spark)
    found = spark.createDataFrame([("/n/f", "NO_TARGET"), ("/t/f", "MATCH"), ("/t/d", "CONTENT")], "path string, status string")
    row = counters(outcomes(lines, held, "verify", found), "verify").first().asDict()
    assert row == {
        "total": 12, "succ": 7, "fail": 4, "invalid": 1, "added": 0, "deleted": 0, "updated": 0, "mkdir": 0, "copied": 0, "reduced": 4,
    }
    transient = parse_changes(spark.createDataFrame([(f"ADD -rw-r--r-- 3 u g 1 {T1} /a/_temporary/f",)], "raw string"))
    missing = spark.createDataFrame([("/a/_temporary/f", "NO_TARGET")], "path string, status string")
    assert counters(outcomes(transient, held, "verify", missing), "verify").first().fail == 1
    assert counters(outcomes(transient, held), "copy").first().succ == 1
    gone = counters(delete_outcomes(lines, held), "delete").first().asDict()
    assert gone["deleted"] == 3 and gone["added"] == gone["fail"] == 0 and gone["invalid"] == 1


def test_folders_above_protected_paths_stay(spark):
    src = listing(spark, ("/user", 0, T1, "drwxr-xr-x"), ("/user/ann", 0, T1, "drwxr-xr-x"), ("/user/ann/f", 1, T1), ("/data", 0, T1, "drwxr-xr-x"))
    doomed = plan_source_delete(src, src, recursive=True)
    assert sorted(r.path for r in doomed.collect()) == ["/data", "/user/ann/f"]


def test_access_list_marks_and_unreadable_modes(spark):
    text = [(f"ADD {mode} 3 u g 1 {T1} /m/{k}",) for k, mode in enumerate(["-rw-r--r--+", "-rw-r--r--", "-zz-r--r--"])]
    plan = plan_actions(outcomes(parse_changes(spark.createDataFrame(text, "raw string")), target(spark)))
    got = {(r.path, r.action): r.arg for r in plan.where("action in ('CHMOD', 'FAIL')").collect()}
    assert got == {("/m/0", "CHMOD"): "644", ("/m/1", "CHMOD"): "644", ("/m/2", "FAIL"): "bad_mode"}


def test_unknown_ops_are_failures(spark):
    done = apply_changes(target(spark).drop("pos"), target(spark), change_rows(spark).where("op = 'MOVE' or op is null"))
    assert sorted((r.path or "", r.op or "", r.reason) for r in done.failures.collect()) == [
        ("", "", "unknown_op"), ("/n/f", "MOVE", "unknown_op"),
    ]
    assert done.snapshot.count() == 4


def test_failed_change_below_a_deleted_folder_keeps_its_row(spark):
    text = [(f"DELETE drwxr-xr-x - u g 0 {T1} /t/d",), (f"UPDATE -rw-r--r-- 3 u g 1 {T1} /t/d/x",)]
    done = apply_changes(target(spark).drop("pos"), target(spark).where("false"), parse_changes(spark.createDataFrame(text, "raw string")), tree=True)
    assert sorted(r.path for r in done.snapshot.collect()) == ["/t/d/x", "/t/f", "/t/f2"]
    assert [(r.path, r.reason) for r in done.failures.collect()] == [("/t/d/x", "source_missing")]


def test_sync_of_nothing(spark, tmp_path):
    tree = target(spark)
    same = sync_diff(spark, tree, tree, str(tmp_path / "same"))
    assert same.changes.count() == same.failures.count() == 0 and same.snapshot.count() == 4
    empty = sync_full(spark, tree.where("false"), str(tmp_path / "empty"))
    assert empty.snapshot.count() == empty.changes.count() == 0
