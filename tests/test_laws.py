"""Many small random trees at once, against the rules written out in plain Python."""

import random
from collections import Counter

import pytest
from compare import spark_rows

from lakekeep.operators.diff import change_lines, snapshot_diff
from lakekeep.operators.keyed import last_wins
from lakekeep.operators.split import split_work
from lakekeep.plans.apply import apply_changes
from lakekeep.sources.listing import parse_changes, parse_listing

TREES = 60


def random_lines(rng, tree, repeats):
    lines = []
    for name in rng.sample("abcdefgh", 5):
        folder = rng.choice(["", "", "/.Trash", "/_temporary"])
        for _ in range(rng.choice([1, 1, repeats])):
            lines.append(
                f"-rw-r--r-- {rng.choice('23')} u g {rng.randint(1, 2)} 2020-01-0{rng.randint(1, 2)} 10:00 /t{tree}{folder}/{name}"
            )
    rng.shuffle(lines)
    return lines


def kept(lines):
    return [x for x in lines if not any(m in x for m in ("/.Trash/", "/_temporary/"))]


def expected_changes(old, new, ignore_time):
    def value(line):
        parts = line.split(" ")
        return parts[:5] if ignore_time else parts[:7]

    last = {x.split(" ")[7]: x for x in kept(old)}
    seen, out = set(), []
    for line in kept(new):
        path = line.split(" ")[7]
        seen.add(path)
        if path not in last:
            out.append(f"ADD {line}")
        elif value(last[path]) != value(line):
            out.append(f"UPDATE {line}")
    return Counter(out + [f"DELETE {x}" for p, x in last.items() if p not in seen])


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(11)
    old, new = [], []
    for tree in range(TREES):
        old += random_lines(rng, tree, 3)
        new += random_lines(rng, tree, 2)
    frames = [
        parse_listing(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "raw string, pos int"))[0].cache()
        for lines in (old, new)
    ]
    return old, new, *frames


@pytest.mark.parametrize("ignore_time", [False, True])
def test_diff_lines(pairs, ignore_time):
    old_lines, new_lines, old, new = pairs
    changes = change_lines(snapshot_diff(old, new, ignore_time=ignore_time))
    assert Counter(r.value for r in changes.collect()) == expected_changes(old_lines, new_lines, ignore_time)


def test_applied_diff_gives_the_new_tree(pairs):
    _, _, old, new = pairs
    changes = snapshot_diff(old, new)
    again = parse_changes(change_lines(changes).withColumnRenamed("value", "raw"))
    assert again.where("op is null").count() == 0
    columns = ["permission", "replication", "owner", "grp", "size", "mtime", "path"]
    visible = "path not like '%/.Trash/%' and path not like '%/_temporary/%'"
    base = last_wins(old.where(visible), ["path"], ["pos"]).select(*columns)
    want = last_wins(new.where(visible), ["path"], ["pos"]).select(*columns)
    for told in (changes, again):
        done = apply_changes(base, new.where(visible), told)
        got = done.snapshot.select(*columns)
        assert done.failures.count() == 0
        # Equal rows keep the old copy; those differ from the last new row in nothing the diff compares.
        assert {r.path for r in got.collect()} == {r.path for r in want.collect()}
        assert snapshot_diff(got, want).where("op <> 'UPDATE'").count() == 0


def test_chunks_hold_every_change_once(pairs):
    _, _, old, new = pairs
    changes = snapshot_diff(old, new)
    chunked = split_work(changes, 9)
    assert spark_rows(chunked.drop("idx", "chunk")) == spark_rows(changes)
    sizes = [r["count"] for r in chunked.groupBy("chunk").count().orderBy("chunk").collect()]
    assert len(sizes) <= 9 and len(set(sizes[:-1])) == 1 and sizes[-1] <= sizes[0]
