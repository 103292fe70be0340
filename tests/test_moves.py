"""Moves of very many names by tasks: half done, repeated, in conflict."""

import os
import random

from lakekeep.operators.moves import check_moves, move_files, stored_plan, trash_files


def counts(df):
    return {r.state: r["count"] for r in df.groupBy("state").count().collect()}


def test_ten_thousand_files_stopped_half_way(spark, tmp_path):
    src, trash, plan = tmp_path / "src", tmp_path / "trash", str(tmp_path / "plan")
    for folder in range(20):
        (src / f"d{folder}").mkdir(parents=True)
        for k in range(500):
            (src / f"d{folder}" / f"f{k}").write_bytes(b"%d" % k)
    rows = [(f"file:{src}/d{d}/f{k}", f"file:{trash}/20240101{src}/d{d}/f{k}") for d in range(20) for k in range(500)]
    stored_plan(spark, spark.createDataFrame(rows, "source string, goal string"), plan)
    # What a job that was killed leaves: the stored plan, and some of its names moved.
    rng = random.Random(1)
    for source, goal in rng.sample(rows, 5000):
        os.makedirs(os.path.dirname(goal[5:]), exist_ok=True)
        os.rename(source[5:], goal[5:])
    assert counts(check_moves(spark, plan)) == {"done": 5000, "open": 5000}
    states = trash_files(spark, f"{src}/*", str(trash), "20240101", plan)
    assert counts(states) == {"done": 5000, "moved": 5000}
    assert counts(check_moves(spark, plan)) == {"done": 10000}
    assert not [f for _, _, files in os.walk(src) for f in files]
    assert (trash / f"20240101{src}" / "d7" / "f123").read_bytes() == b"123"
    assert counts(trash_files(spark, f"{src}/*", str(trash), "20240101", plan)) == {"done": 10000}


def test_conflicts_and_missing_names_are_left_alone(spark, tmp_path):
    for name in ("a", "b c", "e%20f"):
        (tmp_path / name).write_text(name)
    (tmp_path / "goal").mkdir()
    (tmp_path / "goal" / "a").write_text("older")
    rows = [(f"file:{tmp_path}/{n}", f"{tmp_path}/goal/{n}") for n in ("a", "b c", "gone", "e%20f", "b c")]
    plan = str(tmp_path / "plan")
    # One name twice, as two attempts of a task would have it.
    held = spark.createDataFrame(rows, "source string, goal string")
    got = counts(move_files(spark, held, plan))
    assert got == {"conflict": 1, "moved": 2, "missing": 1, "done": 1}
    assert (tmp_path / "goal" / "a").read_text() == "older" and (tmp_path / "a").read_text() == "a"
    assert (tmp_path / "goal" / "b c").read_text() == "b c" and (tmp_path / "goal" / "e%20f").exists()
    assert counts(check_moves(spark, plan)) == {"conflict": 1, "done": 3, "missing": 1}


def test_trash_files_of_a_glob(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "x").write_text("x")
    (tmp_path / "in" / "deep" / "y z").write_text("y")
    (tmp_path / "kept").write_text("k")
    states = trash_files(spark, str(tmp_path / "in"), str(tmp_path / "trash"), "20240102", str(tmp_path / "plan"))
    assert counts(states) == {"moved": 2}
    assert (tmp_path / "trash" / f"20240102{tmp_path}" / "in" / "deep" / "y z").read_text() == "y"
    assert (tmp_path / "kept").exists()


def test_empty_plan(spark, tmp_path):
    none = spark.createDataFrame([], "source string, goal string")
    assert move_files(spark, none, str(tmp_path / "plan")).count() == 0
