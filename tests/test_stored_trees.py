"""Trees compared by stored folder digests, and diffs of bucketed snapshots."""

import random
import re

import pytest
from compare import spark_rows
from test_changes import T1, T2, listing

from lakekeep.operators.diff import snapshot_diff
from lakekeep.operators.digests import differing_folders, read_digests, tree_mismatches, verify_tree, write_digests
from lakekeep.operators.verify import mismatches, verify
from lakekeep.sources.snapshot_table import store_snapshot, stored_diff

SCHEMA = "path string, digest string, is_file boolean"


def tree(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, df, path):
    write_digests(df, str(path))
    return read_digests(spark, str(path))


def random_pair(seed):
    rng = random.Random(seed)
    src = []
    for _ in range(300):
        depth = rng.randint(1, 5)
        path = "".join(f"/{rng.choice('abc')}" for _ in range(depth)) + f"/f{rng.randint(0, 9)}"
        src.append((path, rng.choice(["1", "2", "3", None] if path.startswith("/a/a") else ["1", "2"]), rng.random() < 0.9))
    dst = []
    for path, digest, file in src:
        fate = rng.random() if path.startswith(("/b", "/a/c")) else 1
        if fate > 0.1:
            dst.append((path, "changed" if fate < 0.2 else digest, file if fate > 0.25 else not file))
    dst += [("/b/new/f", "1", True), ("/c/.Trash/x", "1", True), ("/only/here/f", "1", True)]
    rng.shuffle(dst)
    return src, dst


@pytest.mark.parametrize("seed", [1, 2])
def test_verify_tree_equals_verify(spark, tmp_path, seed):
    src, dst = (tree(spark, rows) for rows in random_pair(seed))
    digests = [stored(spark, df, tmp_path / name) for name, df in (("s", src), ("d", dst))]
    assert spark_rows(verify_tree(src, dst, *digests)) == spark_rows(verify(src, dst))
    assert spark_rows(tree_mismatches(src, dst, *digests)) == spark_rows(mismatches(verify(src, dst)))


def test_only_differing_subtrees_are_descended(spark, tmp_path):
    rows = [(f"/w/{a}/{b}/f{k}", str(k), True) for a in "xyz" for b in "pq" for k in range(3)] + [("/w/x", None, False)]
    src = stored(spark, tree(spark, rows), tmp_path / "s")
    changed = [(p, "9" if p == "/w/y/q/f1" else d, f) for p, d, f in rows]
    dst = stored(spark, tree(spark, changed), tmp_path / "d")
    assert spark_rows(differing_folders(src, dst)) == {("/", False): 1, ("/w", False): 1, ("/w/y", False): 1, ("/w/y/q", True): 1}


def test_equal_trees_read_the_top_digest_alone(spark, tmp_path):
    rows = random_pair(3)[0]
    rows = [(p, d or "0", f) for p, d, f in rows]
    a, b = (stored(spark, tree(spark, rows[::step]), tmp_path / str(step)) for step in (1, -1))
    # No level below the first is there any more, nor are the trees.
    top_a, top_b = a.where("depth = 0"), b.where("depth = 0")
    missing = spark.createDataFrame([], SCHEMA)
    assert tree_mismatches(missing, missing, top_a, top_b).isEmpty()
    assert differing_folders(a, b).isEmpty()


def test_files_without_digests_and_empty_trees(spark, tmp_path):
    src = tree(spark, [("/a/f", None, True), ("/a/g", "1", True), ("/a", None, False)])
    d = stored(spark, src, tmp_path / "s")
    assert {r.path: r.status for r in verify_tree(src, src, d, d).collect()} == {"/a/f": "UNKNOWN", "/a/g": "MATCH", "/a": "MATCH"}
    none = tree(spark, [])
    empty = stored(spark, none, tmp_path / "n")
    assert verify_tree(none, none, empty, empty).isEmpty()
    assert {r.status for r in verify_tree(src, none, d, empty).collect()} == {"NO_TARGET"}


def pair(spark):
    old = listing(spark, *[(f"/a/f{k}", k, T1) for k in range(50)], ("/a/f1", 7, T1), ("/a/.Trash/t", 1, T1))
    new = listing(spark, *[(f"/a/f{k}", k + (k % 5 == 0), T2 if k % 7 == 0 else T1) for k in range(10, 60)], ("/a/f11", 99, T1), ("/a/.Trash/u", 1, T1))
    return old, new


@pytest.mark.parametrize("ignore_time", [False, True])
def test_stored_diff_equals_snapshot_diff(spark, tmp_path, ignore_time):
    old, new = pair(spark)
    table = f"snap_{ignore_time}"
    spark.sql(f"drop table if exists {table}")
    store_snapshot(old, table, str(tmp_path / "t"), 4)
    got = stored_diff(spark, table, new, ignore_time=ignore_time)
    assert spark_rows(got) == spark_rows(snapshot_diff(old, new, ignore_time=ignore_time))
    spark.sql(f"drop table {table}")


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    old, new = pair(spark)
    spark.sql("drop table if exists snap_plan")
    store_snapshot(old, "snap_plan", str(tmp_path / "t"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = stored_diff(spark, "snap_plan", new)
        diff.collect()
        plan = diff._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[0]
    lines = final.splitlines()

    def depth(line):
        return len(re.match(r"[ :]*([+:]- )?", line).group())

    scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line and "snap_plan" in line]
    assert len(scans) == 2 and final.count("Bucketed: true") == 2
    for k in scans:
        # Up the tree from the scan to its join: no exchange between them.
        at, above = depth(lines[k]), []
        for line in reversed(lines[:k]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line or "ShuffleQueryStage" in line for line in above)
    spark.sql("drop table snap_plan")
