"""Syncs of trees, and syncs that stop and go on."""

import json

import pytest
from compare import spark_rows
from test_changes import T1, T2, listing

from lakekeep.plans import sync as plans
from lakekeep.plans.sync import sync_diff, sync_resumable
from lakekeep.session import hadoop_path
from lakekeep.sources.ledger import Ledger, LedgerConflict

FOLDER = "drwxr-xr-x"


def paths(df):
    return sorted(r.path for r in df.collect())


def test_transient_rows_of_the_target_stay(spark, tmp_path):
    old = listing(spark, ("/user/u/.Trash/t", 1, T1), ("/a/f", 1, T1), ("/a/_temporary/0/f", 1, T1))
    new = listing(spark, ("/a/f", 2, T2), ("/user/u/.Trash/n", 1, T1))
    done = sync_diff(spark, old, new, str(tmp_path / "out"))
    assert {(r.path, r.size) for r in done.snapshot.collect()} == {("/user/u/.Trash/t", 1), ("/a/f", 2), ("/a/_temporary/0/f", 1)}
    assert {(r.op, r.path) for r in done.changes.collect()} == {("UPDATE", "/a/f")}


def tree_pair(spark):
    old = listing(
        spark, ("/d", 0, T1, FOLDER), ("/d/f", 1, T1), ("/d/.Trash/t", 1, T1), ("/q", 0, T1, FOLDER), ("/q/x", 1, T1),
        ("/keep", 0, T1, FOLDER), ("/keep/f", 1, T1), ("/dd", 1, T1),
    )
    new = listing(spark, ("/q", 1, T1), ("/keep", 0, T1, FOLDER), ("/keep/f", 1, T2), ("/dd", 1, T1), ("/keep/n", 1, T1))
    there = old.unionByName(listing(spark, ("/d/unlisted/deep", 1, T1), ("/keep/unlisted", 1, T1), ("/q/unlisted", 1, T1)))
    return old, new, there


TREE_PATHS = ["/dd", "/keep", "/keep/f", "/keep/n", "/keep/unlisted", "/q", "/q/unlisted"]


def test_a_deleted_folder_takes_unlisted_and_transient_rows(spark, tmp_path):
    old, new, there = tree_pair(spark)
    done = sync_diff(spark, old, new, str(tmp_path / "out"), tree=True, target=there)
    assert paths(done.snapshot) == TREE_PATHS
    assert [(r.raw.split(" ")[-1], r.reason) for r in done.failures.collect()] == [("/q", "kind_conflict")]
    assert [r.permission for r in done.snapshot.where("path = '/q'").collect()] == [FOLDER]


def test_resumed_tree_sync_equals_one_pass(spark, tmp_path):
    old, new, there = (df.drop("pos") for df in tree_pair(spark))
    out = str(tmp_path / "out")
    assert sync_resumable(spark, old, new, out, chunks=3, tree=True, target=there, most=1).synced is None
    done = sync_resumable(spark, old, new, out, chunks=3, tree=True, target=there)
    assert paths(done.synced.snapshot) == TREE_PATHS
    assert [r.reason for r in done.synced.failures.collect()] == ["kind_conflict"]
    assert sorted(done.states.values()) == ["done", "done", "failed"]


def big_pair(spark):
    old = listing(spark, *[(f"/a/f{k}", k, T1) for k in range(60)])
    new = listing(spark, *[(f"/a/f{k}", k + k % 2, T1) for k in range(20, 90)])
    return old.drop("pos"), new.drop("pos")


def test_a_call_does_open_chunks_alone(spark, tmp_path, monkeypatch):
    old, new = big_pair(spark)
    out = str(tmp_path / "out")
    decided = []

    def spy(target, source, told, *rest):
        decided.append(told)
        return real(target, source, told, *rest)

    real = plans.decide
    monkeypatch.setattr(plans, "decide", spy)

    def worked():
        """Chunks that jobs were made for; the first call of each run reads the schema alone."""
        found = [sorted(r.chunk for r in told.select("chunk").distinct().collect()) for told in decided[1:]]
        decided.clear()
        return found

    first = sync_resumable(spark, old, new, out, chunks=8, most=4, wave=2)
    assert first.worked == [0, 1, 2, 3] and first.synced is None
    assert worked() == [[0, 1], [2, 3]]

    # A stop between chunks: the wave after the next one breaks off before it is entered.
    def broken(self, state, after):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", broken)
        with pytest.raises(KeyboardInterrupt):
            sync_resumable(spark, old, new, out, chunks=8, wave=2)
    assert worked() == [[4, 5]]
    last = sync_resumable(spark, old, new, out, chunks=8, wave=2)
    assert last.worked == [4, 5, 6, 7] and worked() == [[4, 5], [6, 7]]
    assert set(last.states.values()) == {"done"}
    one = sync_diff(spark, old, new, str(tmp_path / "one"), chunks=8)
    assert spark_rows(last.synced.snapshot) == spark_rows(one.snapshot)
    assert spark_rows(last.synced.changes) == spark_rows(one.changes)
    # And once more: nothing is left to do.
    again = sync_resumable(spark, old, new, out, chunks=8)
    assert again.worked == [] and worked() == []
    assert spark_rows(again.synced.snapshot) == spark_rows(one.snapshot)


def test_failed_chunks_are_tried_again(spark, tmp_path):
    old, new = big_pair(spark)
    out = str(tmp_path / "out")
    changes = plans.snapshot_diff(old, new)
    lost = new.where("path <> '/a/f77'")
    first = plans.run_chunks(spark, old, lost, changes, out, chunks=8)
    assert sorted(first.states.values()) == ["done"] * 7 + ["failed"]
    assert [(r.raw.split(" ")[-1], r.reason) for r in first.synced.failures.collect()] == [("/a/f77", "source_missing")]
    second = plans.run_chunks(spark, old, new, changes, out, chunks=8)
    assert len(second.worked) == 1 and second.synced.failures.isEmpty()
    assert spark_rows(second.synced.snapshot) == spark_rows(new)
    _, state = Ledger(spark, f"{out}/ledger").last()
    assert sorted(c["attempts"] for c in state["chunks"].values()) == [1] * 7 + [2]


def test_resumable_sync_of_nothing(spark, tmp_path):
    old, _ = big_pair(spark)
    done = sync_resumable(spark, old, old, str(tmp_path / "out"))
    assert done.states == {} and spark_rows(done.synced.snapshot) == spark_rows(old) and done.synced.failures.isEmpty()


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.last() == (0, None)
    assert ledger.commit({"a": 1}, 0) == 1
    with pytest.raises(LedgerConflict):
        ledger.commit({"a": 2}, 0)
    # A file that a crash left unfinished is no state, and its number is not used again.
    fs, at = hadoop_path(spark, str(tmp_path / "ledger" / "000000000002.json"))
    stream = fs.create(at, False)
    stream.write(bytearray(b'{"a": '))
    stream.close()
    assert ledger.last() == (2, {"a": 1})
    assert ledger.commit({"a": 3}, 2) == 3
    assert ledger.last() == (3, {"a": 3})
    for k in range(3, 40):
        ledger.commit({"a": k}, k)
    assert ledger.last() == (40, {"a": 39})
    assert len(list((tmp_path / "ledger").glob("*.json"))) == 20
    assert json.loads((tmp_path / "ledger" / "000000000040.json").read_text()) == {"a": 39}
