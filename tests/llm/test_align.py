"""Alignment of tokenizers against plain loops with the libraries' own encoders."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import documents, folder, frame
from tokenizers import Tokenizer

from lakekeep.llm.align import Csr, align_tokenizers, overlaps, row_products
from lakekeep.llm.bpe import printable_bytes
from lakekeep.llm.queries import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    a_lib, b_lib = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_lib.encode_special_tokens = True
    to_byte = printable_bytes()

    def b_bytes(i):
        p = b_lib.IdToPiece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.IsByte(i) else p.replace("▁", " ").encode()

    held, counts = [], Counter()
    for i, text in rows:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        pa = [bytes(to_byte[c] for c in a_lib.id_to_token(x)) for x in a]
        pb = [b_bytes(x) for x in b]
        if not text or b"".join(pa) != b" " + text.encode() or b"".join(pb) != b" " + text.encode():
            held.append((i, [], [], [], Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, ka, kb = [], 0, 0
        for end in common:
            ga, gb = [], []
            while ka < len(a) and ends_a[ka] <= end:
                ga.append(a[ka])
                ka += 1
            while kb < len(b) and ends_b[kb] <= end:
                gb.append(b[kb])
                kb += 1
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(set(links))
        held.append((i, a, b, groups, links))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, a, b, groups, links in held:
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((
            i, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == top[p[0]]),
            sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=repr)


def rows():
    out = [(i, t) for i, t, *_ in documents()]
    return out + [(200, "a" * 3000), (201, " " * 500 + "x"), (202, "\n" * 300), (203, "two  blanks\tand\x00nul <s> </s> <0x41> ▁"), (204, "ﬁ ligature ①"), (None, "é" * 50), (200, "=-" * 400)]


@pytest.mark.parametrize(("resident", "shard_pairs"), [(128 << 20, 1 << 20), (128 << 20, 300), (0, 300)])
def test_align_equals_brute_force(spark, resident, shard_pairs):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, n_a int, row string").repartition(3)
    found = align_tokenizers(df, *FILES, resident=resident, shard_pairs=shard_pairs)
    got = sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in found.collect()), key=repr)
    assert got == brute(data)


def test_query_and_empty_table(spark, tmp_path):
    sf = folder(tmp_path, documents=frame(spark))
    found = QUERIES["op11_alignment"](spark, sf).collect()
    assert sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in found), key=repr) == brute([(i, t) for i, t, *_ in documents()])
    assert align_tokenizers(frame(spark, []), *FILES).collect() == []


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_row_products_equal_dense(most):
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3, (20, 30)) * (rng.random((20, 30)) < 0.2), rng.integers(0, 3, (30, 11)) * (rng.random((30, 11)) < 0.3)

    def sparse(m):
        rows, columns = np.nonzero(m)
        return Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns])

    dense = np.zeros((20, 11), dtype=np.int64)
    for r, c, v in row_products(sparse(left), sparse(right), 11, most):
        dense[r, c] = v
    assert np.array_equal(dense, left @ right)


def test_overlaps_share_bytes():
    a, b, shared = overlaps(np.array([3, 2, 1]), np.array([1, 4, 1]))
    assert list(zip(a.tolist(), b.tolist(), shared.tolist())) == [(0, 0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 1)]
