"""The conversation trie against nested dictionaries; sums over subtrees against plain recursion."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakekeep.llm.prefix_trie import centroid_sums, prefix_trie
from lakekeep.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    held = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    members = {}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = int(np.fmod(c, 20))
        rebuilt[c] = own.get(c - rest, [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    out = []
    for key, ms in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(ms) if len(rebuilt[c]) == len(key))
        out.append((
            min(ms), len(key), min(members[key[:-1]]) if key else None, len(ms), len(children), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    texts = ["hello there", "how are you", "", None, "one two\tthree", "é ü", "x " * 50]
    out = []
    for c in range(-25, 90):
        if rng.random() < 0.2:
            continue
        n = rng.choice([1, 2, 3, 5, 8])
        for t in range(n):
            out.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(texts[:3]) if t < 3 else rng.choice(texts)))
    for c in range(200, 240):  # copies of one conversation, and near ones
        out += [(c, t, "user", f"copied turn {t}") for t in range(6)] + ([(c, 7, "user", str(c))] if c % 3 == 0 else [])
    out += [(300, t, "user", f"long {t}") for t in range(400)] + [(301, t, "user", f"long {t}") for t in range(390)]
    out += [(302, 5, "user", "tie a"), (302, 5, "user", "tie b"), (302, 5, "user", "tie b"), (302, 6, "user", "tie b"), (None, 1, "user", "nobody")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("piece", "high_piece"), [(4096, 1 << 18), (30, 90), (30, 1 << 18)])
def test_trie_equals_brute_force(spark, piece, high_piece):
    data = rows()
    df = spark.createDataFrame([(*r, "n", "d") for r in data], SCHEMA).repartition(3)
    found = prefix_trie(df, piece, high_piece)
    assert tuple(found.columns) == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(data)


def test_query_on_empty_and_turnless(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect() == []
    lone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    data = [(lone, 0, "user", "gone")]
    found = prefix_trie(spark.createDataFrame([(*r, "n", "d") for r in data], SCHEMA)).collect()
    assert [tuple(r) for r in found] == brute(data)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "broom"])
def test_centroid_sums_equal_recursion(shape):
    rng = np.random.default_rng(7)
    n = 400
    parent = np.array([-1] + [{"random": int(rng.integers(0, k)), "chain": k - 1, "star": 0, "broom": k - 1 if k < 200 else 199}[shape] for k in range(1, n)])
    parent[[k for k in (50, 120) if shape == "random"]] = -1
    weights = rng.integers(-5, 100, (n, 2))
    want, span = weights.copy(), rng.integers(1, 4, n)
    for v in range(n - 1, 0, -1):
        if parent[v] >= 0:
            want[parent[v]] += want[v]
            span[parent[v]] += span[v]
    assert np.array_equal(centroid_sums(parent, span, weights), want)
