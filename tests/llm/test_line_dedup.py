"""Line dedup against a plain dictionary of lines, in place and by shard."""

import hashlib
import random

import numpy as np
import pytest
from fixtures import documents, folder, frame

from lakekeep.llm.line_dedup import SPACE, PerfectHash, dedup_lines
from lakekeep.llm.queries import QUERIES

A_LINE = "A line that stands in very many documents"
SCHEMA = "doc_id long, text string, kept string, n_lines string"


def brute(rows):
    """The contract in plain Python; rows are (doc_id, text)."""
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE.decode()))
        return k if len(k) >= 20 else None

    held = {}
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")} - {None}:
            n, top = held.get(k, (0, None))
            held[k] = (n + 1, i if top is None else max(top, i) if i is not None else top)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept, most = [], 0
        for line in lines:
            k = key(line)
            if k and held[k][0] >= 3 and held[k][1] != i:
                most = max(most, held[k][0])
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept), most))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    shared = [A_LINE, "  \t" + A_LINE.upper() + "\r", "ÀÉ ünïcode line of 20 c", "x" * 19, "é" * 20, "é" * 19, "日本語" * 7, ""]
    out = [(i, t) for i, t, *_ in documents()]
    for i in range(100, 160):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line number {rng.randint(0, 40)} of this kind" for _ in range(rng.randint(1, 9))]
        out.append((i if i % 9 else None, "\n".join(lines)))
    out += [(159, A_LINE + "\n\n" + A_LINE), (159, A_LINE), (None, A_LINE), (7, "\n".join(f"long text line {k % 700} of many lines" for k in range(5000)))]
    out += [(300 + k, "only without\n" + "\n".join(f"long text line {j} of many lines" for j in range(300))) for k in range(3)]
    out += [(None, "a line that only rows without an id hold")] * 4
    return out


@pytest.mark.parametrize("resident", [128 << 20, 0])
@pytest.mark.parametrize("shard_keys", [1 << 17, 50])
def test_dedup_equals_brute_force(spark, resident, shard_keys):
    data = rows()
    df = spark.createDataFrame([(i, t, "kept", "n") for i, t in data], SCHEMA).repartition(3)
    found = dedup_lines(df, resident=resident, shard_keys=shard_keys)
    assert found.columns == ["doc_id", "kept", "n_lines", "n_dropped", "most_docs"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(data)


def test_digest_query(spark, tmp_path):
    sf = folder(tmp_path, documents=frame(spark))
    found = QUERIES["op13_line_dedup"](spark, sf).collect()
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest(), m) for i, k, n, d, m in brute([(i, t) for i, t, *_ in documents()])]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.most_docs) for r in found), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-(2**63), 2**63 - 1, size=(2, 20_000))
    high[:100] = 7  # keys that share a half are still told apart
    hashed = PerfectHash.of(high, low)
    assert np.array_equal(np.sort(hashed.slots(high, low)), np.arange(20_000))
    others = hashed.slots(low, high)
    assert others.max() < 20_000 and others.min() >= -1
