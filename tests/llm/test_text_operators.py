"""Operators on whole texts against plain Python."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, frame, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from lakekeep.llm import bpe, jaccard, langid, secret_scan, winnow
from lakekeep.llm.common import only
from lakekeep.llm.queries import bpe_digest, held_out

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_equals_the_library(spark):
    reference = Reference.from_file(PATH)
    got = collections.Counter(tuple(r) for r in bpe_digest(frame(spark)).collect())
    want = collections.Counter()
    for i, text, *_ in documents():
        ids = reference.encode(text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, dtype="<u4").tobytes()
        want[i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert got == want


def test_bpe_scan_and_heap_agree():
    with open(PATH, "rb") as f:
        own = bpe.Tokenizer(f.read())
    words = [b"internationalisation", b"aaaaaaaaaaaaaaaa", "straßenbahn".encode(), b"x", b"abababababab"]
    assert own._scan_rows(words, 65) == [own._heap(w) for w in words]
    small = bpe.CACHED
    try:
        bpe.CACHED = 3
        assert own.encode("one two three four five six") == own._heap(b"one") + b"".join(own._heap(w) for w in (b" two", b" three", b" four", b" five", b" six"))
    finally:
        bpe.CACHED = small


def test_bpe_with_a_cache_of_a_few_words(monkeypatch):
    """Words are forgotten all the time, within a long text too; the ids stay those of the library."""
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "HELD", 40)
    with open(PATH, "rb") as f:
        own = bpe.Tokenizer(f.read())
    reference = Reference.from_file(PATH)
    texts = [t or "" for _, t, *_ in documents() if len(t or "") < 10_000]
    got = [ids for start in range(0, len(texts), 7) for ids in own.encode_all(texts[start : start + 7])]
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.cache) <= 3 + 40 * 7


def test_bpe_empty_table(spark):
    assert bpe_digest(frame(spark, [])).count() == 0


def greedy_phrases(text: bytes, known: bytes) -> int:
    at = count = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known and text[at:end] in known:
            end += 1
        at, count = end, count + 1
    return count


def test_cross_parse_counts_longest_phrases():
    samples = {"en": ["the thing and the other thing"], "de": ["der und die andere ding"]}
    parser = langid.CrossParser(samples)
    known = [b"".join(langid.normal_bytes(f" {t} ").tobytes() for t in parts) for parts in samples.values()]
    texts = [langid.normal_bytes(t) for t in ("the other und!", "zzz", "and the thing and then", "d")]
    want = [[greedy_phrases(t.tobytes(), k) for k in known] for t in texts]
    assert parser.phrases(texts).tolist() == want


def test_language_of_held_out_texts(spark):
    docs = frame(spark)
    samples = langid.training_sample(docs, ~held_out())
    assert list(samples) == ["de", "en", "fr"]
    rows = langid.identify(only(docs, "doc_id", "text"), samples).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(documents())
    assert all(found[i]["lang_pred"] == ("en", "de", "fr")[i % 3] for i in range(60))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (60, 61, 62, 63))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert found[71]["lang_pred"] == "en" and found[64]["lang_pred"] == "en"


def test_language_without_labels_or_rows(spark):
    docs = frame(spark)
    none = langid.training_sample(frame(spark, []), ~held_out())
    assert none == {}
    assert {r["lang_pred"] for r in langid.identify(only(docs, "doc_id", "text"), none).collect()} == {"und"}
    assert langid.identify(only(frame(spark, []), "doc_id", "text"), {"en": ["the"]}).count() == 0


def test_copies_do_not_empty_a_language(spark):
    """Fewer different texts than rows: all are sampled, and a language of copies stays known."""
    base = [(k, prose(lang, 30, 7000 + k), lang) for lang, n in (("de", 10), ("fr", 10), ("en", 300)) for k in range(n)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string")
    copies = docs.where("lang <> 'en'").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("_")
    samples = langid.training_sample(copies.unionByName(docs.where("lang = 'en'")), F.lit(True))
    assert {lang: len(parts) for lang, parts in samples.items()} == {"de": 10, "en": 120, "fr": 10}


def test_language_accuracy_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.training_sample(docs, ~held_out())
    rows = langid.identify(only(docs.where(held_out()).where("lang is not null"), "lang", "text"), samples).collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.93 * len(rows)


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = collections.defaultdict(list)
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[top(k)].append(row[0])
    return collections.Counter((row[0], len(sets[k]), min(least[top(k)], default=None)) for k, row in enumerate(rows))


@pytest.mark.parametrize("percent", [80, 50])
def test_jaccard_components_equal_brute_force(spark, percent):
    rows = documents()
    rows += [(r[0] + 200, " ".join((r[1] or "").split()[: 18 + k % 5]), *r[2:]) for k, r in enumerate(rows[:40])]
    rows.append((5, "another text under a number that is taken already", *rows[0][2:]))
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(frame(spark, rows), percent).collect())
    assert got == brute_components(rows, percent)


def test_a_block_pair_takes_little_memory():
    """Two blocks of 1,024 sets: all links across, within 60 MB; the counts of all pairs at once took some 140 MB."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, 64, dtype=np.uint64)) for _ in range(40)]
    rows = [(7 * k % 2053, k % 5, k % 2, base[k % 40].tobytes()) for k in range(2048)]
    tracemalloc.start()
    try:
        found = jaccard.block_links(rows, 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    # Sides and components of equal sets: side k % 2, component k % 5 are those of k % 40, so no set links with its equals.
    assert found == []
    mixed = [(sid, k, k // 1024, tokens) for k, (sid, _, _, tokens) in enumerate(rows)]
    least = {}
    for sid, _, _, tokens in mixed:
        least[tokens] = min(sid, least.get(tokens, sid))
    assert sorted(jaccard.block_links(mixed, 80)) == sorted((s, least[t]) for s, _, _, t in mixed if s != least[t])


@pytest.mark.parametrize("short", [3, 1000])
def test_jaccard_with_long_lists_and_chains(spark, monkeypatch, short):
    """Long lists, a full map and chains of links: only the speed may differ."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(80):
        words = base[i // 4 :] + [f"v{k}" for k in range(i // 4)]
        rows.append((i, " ".join(words), None, None, 0, None, None))
    rows += [(100 + i, " ".join([f"q{i}_{k}" for k in range(40)] + base[:20]), None, None, 0, None, None) for i in range(40)]
    monkeypatch.setattr(jaccard, "LIST_PART", 4)
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_jaccard_keeps_one_of_each(spark):
    rows = documents()
    kept = jaccard.one_of_each(frame(spark, rows)).collect()
    ids = sorted((r["doc_id"] for r in kept if r["doc_id"] is not None))
    component = {(i, c) for (i, _, c) in brute_components(rows)}
    assert ids == sorted({c for _, c in component if c is not None})
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_jaccard_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(
        (
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
        )
    ):
        for m in re.finditer(pattern, text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


SECRETS = [
    "password=secret : abcdefghijk", "PASSWORD='aaaaaaaa' Api_Key: b.b=c/d+e_f-g apikey=1234567", "é" * 40 + "token=" + "z" * 9,
    "AKIAKIAKIAKIAKIA AKIA" + "A" * 11 + " AKIA" + "B" * 12, "f" * 31 + "g" + "e" * 32 + "0" * 40, "secretsecret=abcdefgh", "😀 passwd \n= abcdefgh token=😀abcdefgh",
]


def test_base_secrets_equal_python(spark):
    rows = documents() + [(300 + k, t, *documents()[0][2:]) for k, t in enumerate(SECRETS)]
    found = secret_scan.scan(only(frame(spark, rows), "doc_id", "text")).collect()
    got = collections.Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] != "random")) for r in found)
    assert got == collections.Counter((r[0], tuple(base_spans(r[1]))) for r in rows)


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    rows = []
    for k in range(200):
        token = "".join(rng.choice(letters, 40))
        plain = "version_of_the_long_identifier_name_2024_final" if k % 2 else "1111111111111111111111aaaaaaaaaaaaaaaaaaaa"
        rows.append((k, f"one {token} two {plain} three", "en", "s", 1, None, None))
    found = secret_scan.scan(only(frame(spark, rows), "doc_id", "text")).collect()
    random = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in found}
    hits = sum((4, 44) in spans for spans in random.values())
    false = sum(start > 44 for spans in random.values() for start, _ in spans)
    assert hits >= 170 and false == 0


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def random_tokens(n, seed, letters=BASE64, size=40):
    """Random tokens that hold a digit and a letter."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        token = "".join(rng.choice(list(letters), size))
        if re.search("[0-9]", token) and re.search("[A-Za-z]", token):
            out.append(token)
    return out


def p_values(spark, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "text string")
    found = df.select("text", F.explode(secret_scan.candidates(F.col("text"))).alias("t")).select("text", "t.p").collect()
    return {r["text"]: r["p"] for r in found}


def found_random(spark, tokens):
    """Those of the tokens, one for each document, that are found to be random."""
    rows = [(k, t) for k, t in enumerate(tokens)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {tokens[r["doc_id"]] for r in found if any(s["kind"] == "random" for s in r["spans"])}


def test_copies_of_a_token_change_no_threshold(spark):
    tokens = random_tokens(300, 5)
    p = p_values(spark, tokens)
    low = min((t for t in p if p[t] > 0.25), key=p.get)
    high = max(p, key=p.get)
    alone = found_random(spark, tokens)
    assert len(alone) > 250 and low in alone
    assert found_random(spark, tokens + [low] * 500) == alone
    assert found_random(spark, tokens + [high] * 500) == alone


def test_digit_and_letter_may_stand_anywhere_in_a_token(spark):
    late = ["QwErTyUiOpAsDfGhJkLzXcVbNm+qWeRtYuIoPaSd7", "12345678901234567890123456789a", "x" * 200_000 + "1"]
    never = ["a" * 200_000, "1" * 200_000, "abcdefghijklmnopqrs1"[:19]]
    assert set(p_values(spark, late + never)) == set(late)
    # One in thirty base64 tokens has no digit in its first 20 characters.
    tokens = random_tokens(1000, 11)
    assert any(not re.search("[0-9]", t[:20]) for t in tokens) and set(p_values(spark, tokens)) == set(tokens)


def test_a_lone_random_token_of_its_class_is_found(spark):
    some = random_tokens(40, 21, "0123456789ABCDEF")
    p = p_values(spark, some)
    lone = min((t for t in some if p[t] > 0.25), key=p.get)
    assert p[lone] < 0.5
    # Alone in the table, with another class, and among ordinary tokens of its class.
    ordinary = [f"{k:04d}AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA" for k in range(50)]
    others = random_tokens(300, 22)
    assert found_random(spark, [lone]) == {lone}
    found = found_random(spark, [lone, *others, *ordinary])
    assert lone in found and not found & set(ordinary) and len(found) > 250


def bin_rows(spark, counts):
    return spark.createDataFrame([(e, n, b, c) for (e, n), bins in counts.items() for b, c in bins.items()], "enc string, len int, bin int, c long")


def least_p(spark, counts):
    return {(r["enc"], r["len"]): r["least_p"] for r in secret_scan.thresholds(bin_rows(spark, counts)).collect()}


def test_thin_classes_are_judged_by_their_neighbours(spark):
    uniform = {b: 10 for b in range(100)}
    got = least_p(spark, {("b64", 21): {**uniform, 0: 2010}, ("b64", 22): {30: 1}, ("HEX", 21): {43: 1}, ("hex", 40): {5: 400, 80: 1}})
    assert got["b64", 21] == got["b64", 22] == got["HEX", 21] == 0.01
    # Enough of its own: judged by itself.
    assert got.get(("hex", 40), 1.0) > 0.05
    # Few tokens in all: ordinary ones bring at most the one or two that lie highest.
    assert least_p(spark, {("HEX", 21): {43: 1}}) == {("HEX", 21): 0.01}
    assert least_p(spark, {("HEX", 21): {2: 18, 43: 1}})["HEX", 21] > 0.02
    assert least_p(spark, {}) == {}


def test_a_text_of_very_many_matches(spark):
    """Places of 100,000 keys in one text, and the text without them, in time that grows in proportion."""
    import time

    rng = random.Random(3)
    keys = [f"{rng.getrandbits(128):032x}" for _ in range(100_000)]
    text = "".join(f"é{'ü' * (k % 3)} {key}\n" for k, key in enumerate(keys))
    want = [(m.start(), m.end(), m.group()) for m in re.finditer(secret_scan.HEX, text)]
    df = spark.createDataFrame([(text,)], "text string")
    spans = F.transform("found", lambda m: F.struct(F.lit("hex").alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    begin = time.monotonic()
    row = df.select("text", secret_scan.matches(F.col("text"), secret_scan.HEX).alias("found")).select(
        "found", secret_scan.redacted(F.col("text"), spans, "#").alias("clean")
    ).first()
    assert time.monotonic() - begin < 60
    assert [tuple(m) for m in row["found"]] == want
    assert row["clean"] == re.sub(secret_scan.HEX, "#", text)


def test_many_overlapping_spans_are_redacted(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abé日 ") for _ in range(4000))
    spans = sorted((s, s + rng.randint(1, 9)) for s in (rng.randint(0, 3980) for _ in range(1500)))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "#"]
        at = max(at, end)
    df = spark.createDataFrame([(text, [("hex", s, e) for s, e in spans])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert df.select(secret_scan.redacted(F.col("text"), F.col("spans"), "#")).first()[0] == "".join(out) + text[at:]


def test_redaction_covers_overlapping_spans(spark):
    df = spark.createDataFrame([("0123456789", [("a", 2, 5), ("b", 3, 4), ("c", 5, 6), ("d", 8, 10)]), ("x", [])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    got = [r[0] for r in df.select(secret_scan.redacted(F.col("text"), F.col("spans"), "#")).collect()]
    assert got == ["01##67#", "x"]


def units(text):
    return re.findall(r"[^\x20\x09-\x0D]{1,16}", text)


def test_winnowing_guarantees(spark):
    rows = documents()
    found = winnow.fingerprints(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    following = {}
    for k, row in enumerate(order):
        following.setdefault(row[0], []).append(order[(k + 1) % len(order)][1] or "")
    assert len(found) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in found:
        text = texts[r["doc_id"]]
        half = len(text) // 2
        edits = {text[: len(text) - half] + n[:half] for n in following[r["doc_id"]]}
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        kept = [p.split(":") for p in r["fingerprint"].split()]
        places = [int(p) for _, p in kept]
        grams = len(units(text)) - 4
        assert places == sorted(set(places)) and all(len(h) <= 8 for h, _ in kept)
        if grams > 8:
            # Every window of 8 grams holds a kept one.
            assert places[0] < 8 and places[-1] >= grams - 8 and max(np.diff([*places, grams - 1])) <= 8
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[61]["fingerprint"] == by_id[60]["fingerprint"] == "" and by_id[60]["near_next"] == 1
    assert by_id[64]["near_next"] > 0.9 and by_id[50]["near_edited"] > 0.2 and by_id[50]["near_next"] < 0.05


def test_winnowing_of_runs_without_blanks(spark):
    """A passage is met wherever it stands in a run, and an early change leaves later fingerprints alone."""
    rng = np.random.default_rng(8)
    run = lambda n, low, high: "".join(map(chr, rng.integers(low, high, n)))
    for low, high in ((0x4E00, 0x9000), (0x61, 0x7B), (0x1F300, 0x1F600)):
        text, passage = run(600, low, high), run(27, low, high)
        texts = [text, text[:3] + "x" + text[3:]] + [run(n, low, high) + passage + run(50 - n, low, high) for n in (16, 17, 23, 30)]
        df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
        rows = df.select("k", winnow.winnowed(F.col("text")).alias("kept")).collect()
        hashes = [{v >> 31 for v in r["kept"]} for r in sorted(rows)]
        assert len(hashes[0] & hashes[1]) > 0.9 * len(hashes[0])
        assert all(a & b for a in hashes[2:] for b in hashes[2:])
        assert not hashes[0] & hashes[2]
    rows = spark.createDataFrame([("a bc  " + "d" * 16 + "\t" + "e" * 15 + "fgh \U0001F600",)], "text string")
    got = rows.select(F.regexp_extract_all("text", F.lit(winnow.UNIT), F.lit(1))).first()[0]
    assert got == ["a", "bc", "d" * 16, "e" * 15 + "f", "e" * 14 + "fg", "e" * 13 + "fgh", "\U0001F600"]


def test_winnowing_takes_the_rightmost_of_ties(spark):
    rows = [(1, "a " * 40, None, None, 0, None, None)]
    found = winnow.fingerprints(frame(spark, rows)).first()
    assert [int(p.split(":")[1]) for p in found["fingerprint"].split()] == list(range(7, 36))
    assert found["near_next"] == 1.0
    assert winnow.fingerprints(frame(spark, [])).count() == 0


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)
    rows = [(i, f"t{i}", None, None, 0, None, None) for i in (5, 1, 9, 9, 30, 31, 32, 2, 77, 12, 13, 14, 15, 16, 17, 40, None)]
    led = winnow.with_next(frame(spark, rows).select("doc_id", "text"), ["text"]).collect()
    order = sorted((r[0] is not None, r[0] or 0, r[1]) for r in rows)
    want = collections.Counter((t, order[(k + 1) % len(order)][2]) for k, (_, _, t) in enumerate(order))
    assert collections.Counter((r["text"], r["next_text"]) for r in led) == want


def test_checksum_of_the_fold_is_that_of_the_contract(spark):
    docs = frame(spark).select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs)
