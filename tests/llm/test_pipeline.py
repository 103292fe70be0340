"""The pipeline on the small table: what each stage decides, and that its decisions hold."""

import collections
import hashlib
import re

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from fixtures import documents, folder, frame
from test_table_operators import water
from test_text_operators import base_spans, brute_components
from tokenizers import Tokenizer as Reference

from lakekeep.llm.common import stored


def test_stages(spark, tmp_path):
    sf = folder(tmp_path, documents=frame(spark))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "test-stage")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
        seen[name] = docs.collect()
    texts = {r[0]: r[1] for r in documents()}
    after = {r.doc_id: r for r in seen["language_id"]}
    assert {60, 61, 62, 63}.isdisjoint(after) and set(range(60)) <= set(after)
    assert all(r.lang in ("de", "en", "fr") for r in seen["language_id"])
    kept = {r.doc_id for r in seen["ngram_jaccard"]}
    assert {70, 71, 65, 77}.isdisjoint(kept) and {64, 69} <= kept and set(range(60)) <= kept
    assert len(seen["ngram_jaccard"]) == len(kept)
    clean = {r.doc_id: r for r in seen["secret_scan"]}
    assert set(clean) == kept and clean[75].text.count("[SECRET]") == 2 and "AKIAABCD" not in clean[75].text
    assert clean[75].n_chars == len(clean[75].text) and clean[5].text == texts[5]
    mixed = seen["mixing"]
    assert {r.doc_id for r in mixed} <= kept and all(clean[r.doc_id].text == r.text for r in mixed)
    assert sorted(r.doc_id or -1 for r in mixed) == sorted(r.doc_id or -1 for r in seen["bpe"])
    assert all(r.n_tokens > 0 for r in seen["bpe"])


def test_empty_table(spark, tmp_path):
    assert pipeline.run(spark, folder(tmp_path, documents=frame(spark, []))).count() == 0


def brute_run(rows):
    """The whole pipeline in plain Python; in the fixture no text is foreign and all random tokens lie in base spans."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    component = {i: c for (i, _, c) in brute_components(rows)}
    kept = {r[0]: r for r in rows if r[0] == component[r[0]]}.values()
    docs = []
    for i, text, _, source, *_ in kept:
        out, at = "", 0
        for _, start, end in base_spans(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        docs.append((i, out + text[at:], source))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sizes = collections.Counter()
    for i, _, source in docs:
        sizes[source] += size[i]
    target = water(dict(sizes))
    reference = Reference.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for source in sizes:
        before, rounds = 0, int(target[source] // sizes[source])
        own = [d for d in docs if d[2] == source]
        for i, text, _ in sorted(own, key=lambda d: hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest()):
            extra = rounds < 3 and before + size[i] / 2 <= target[source] - rounds * sizes[source]
            before += size[i]
            ids = np.array(reference.encode(text, add_special_tokens=False).ids, dtype="<u4")
            decoded = reference.decode(ids.tolist(), skip_special_tokens=False)
            row = (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            if rounds + extra:
                want[row] += rounds + extra
    return want


def test_run_equals_brute_force(spark, tmp_path):
    got = collections.Counter(tuple(r) for r in pipeline.run(spark, folder(tmp_path, documents=frame(spark))).collect())
    assert got == brute_run(documents())
