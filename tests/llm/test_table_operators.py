"""Operators on embeddings, pages and metadata against plain Python, and the queries against their SQL."""

import collections
import glob
import gzip
import hashlib
import random

import numpy as np
import pytest
from compare import check_rows, connect, spark_rows
from fixtures import documents, frame
from pyspark.sql import functions as F

from lakekeep.llm import hilbert, metric_join, mixing, url_filter, warc
from lakekeep.llm.components import components
from lakekeep.llm.queries import CHECKS, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, node string, vec string"


def vectors(n=120, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    base = rng.normal(size=(12, 8))
    for i in range(n):
        v = base[i % 12] + rng.normal(size=8) * 0.12
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3) if i % 11 else None))
    rows += [(n + k, rows[4][1], rows[4][2]) for k in range(30)]
    rows += [
        (500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [None] + [1.0] * 7, 1),
        (505, [float("inf")] + [1.0] * 7, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, [1.0, 2.0], 2), (509, [-0.0, 3.0], 1),
        (510, [0.0, 1.5], 1), (6, rows[6][1], rows[6][2]), (None, rows[5][1], rows[5][2]),
    ]
    return [(*r, "x", "y") for r in rows]


def brute_vectors(rows):
    def valid(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    root = list(range(len(rows)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if valid(x) and valid(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], dtype=float), np.array(y[1], dtype=float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    root[max(top(a), top(b))] = min(top(a), top(b))
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)].append(r[0])
    found = [min(least[top(k)], default=None) for k in range(len(rows))]
    return collections.Counter((r[0], links[k], found[k], r[0] == found[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("cell,homes,chunk", [(4000, 1024, 4096), (5, 3, 4)])
def test_metric_join_equals_brute_force(spark, monkeypatch, cell, homes, chunk):
    """With one cell, and with many pivots, blocks and chunks."""
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "HOMES", homes)
    monkeypatch.setattr(metric_join, "CHUNK", chunk)
    rows = vectors()
    got = metric_join.metric_components(spark.createDataFrame(rows, VECTORS)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_vectors(rows)


@pytest.mark.parametrize("cell", [4000, 3])
def test_metric_join_of_extreme_doubles(spark, monkeypatch, cell):
    """Squares of the components leave the range of doubles; exact fractions tell which pairs link."""
    from fractions import Fraction

    monkeypatch.setattr(metric_join, "CELL", cell)
    base = [(1.0, 0.0), (1.0, 1.0), (1.0, 0.01), (-1.0, 1.0), (1.0, 0.2), (3.0, 2.9), (0.0, 1.0)]
    vecs = [(x * s, y * s) for s in (1.0, 1e-200, 1e200, 1e300, 2.0**-1000) for x, y in base] + [(5e-324, 0.0), (0.0, 5e-324), (5e-324, 5e-324)]
    rows = [(k, list(v), 1) for k, v in enumerate(vecs)]

    def linked(u, v):
        (a, b), (c, d) = (tuple(map(Fraction, w)) for w in (u, v))
        dot = a * c + b * d
        return dot > 0 and dot * dot * 2500 >= 2401 * (a * a + b * b) * (c * c + d * d)

    want = {i: sum(linked(u, v) for j, (_, v, _) in enumerate(rows) if j != i) for i, u, _ in rows}
    got = metric_join.metric_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want


def test_metric_join_of_nothing(spark):
    assert metric_join.metric_components(spark.createDataFrame([], VECTORS)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[k]) for k in range(101, 200)]
    links += [(names[200 + i], names[200 + (i + 1) % 50]) for i in range(50)] + [(names[300], names[300]), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {}
    for part in (names[:100], names[100:200], names[200:250]):
        want |= {n: min(part) for n in part}
    assert {r.node: r.component for r in components(df).collect()} == want


PAGES = "page_id long, url string, html string, key string"
URLS = [
    "http://www.Example.com/en/x?q=1#y", "https://example.com/en/", "https://a.b.example.com/en/z", "http://example.com/de/", "http://x.net/es/1",
    "ftp://x.net/fr/", "http://x.net/en/", "http://com/", "nothing here", None, "http://other.org", "http://xnet/es/", "a://b://c/d", "http://h.co.uk/p",
    "http://net?x=/es/", "http://ÄÉ.Org/Path",
]


def pages(spark, rows=None):
    rng = random.Random(1)
    same = "<p>" + "same " * 300
    if rows is None:
        rows = [(i, u, f"<p>{i}" + "x" * rng.randint(0, 2000), "k") for i, u in enumerate(URLS)]
        rows += [(100 + i, "http://dup.com/a", same, "k") for i in range(5)] + [(104, "http://dup.com/a", same, "k")]
        rows += [(200, "http://z.com/", None, "k"), (201, "http://z.com/", "", "k"), (202, "http://z.com/", "small", "k"), (203, "http://z.com/", "small", "k")]
        rows += [(None, "http://dup.com/b", same, "k"), (300, "http://é.com/ \n", "é\r\n\r\nWARC/1.1\r\n" * 200, "k")]
    return spark.createDataFrame(rows, PAGES)


def test_rules_and_hosts(spark):
    none = spark.createDataFrame([], "url string, bad int")
    rows = url_filter.judge(pages(spark).select("page_id", "url"), none).where("page_id < 100").collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert found[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert found[1] == ("example.com", "/en/", "example.com/en/", "block")
    assert found[2] == ("a.b.example.com", "/en/z", "example.com/en/", "block")
    assert found[3] == ("example.com", "/de/", "com/", "allow")
    assert found[4][2:] == ("net/es/", "block") and found[5][2:] == ("net/fr/", "block") and found[6][2:] == (None, "allow")
    assert found[7] == ("com", "/", "com/", "allow")
    assert found[8] == found[9] == ("", "", None, "allow") and found[10] == ("other.org", "", None, "allow")
    assert found[11][2] is None and found[12][:2] == ("b:", "//c/d") and found[14] == ("net", "", None, "allow")
    assert found[15][:2] == ("ÄÉ.org", "/Path")


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.site.org", 1)] * 40 + [("good.site.org", 0)] * 40 + [("few.site.org", 1)] * 2 + [("one.fine.net", 0)] * 50 + [("new.fine.net", None)]
    rep = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rep["bad.site.org"]["bad_low"] > 0.5 > rep["few.site.org"]["bad_low"]
    assert rep["good.site.org"]["bad_low"] < 0.2 and rep["new.fine.net"]["n"] == 0
    assert 0 < rep["new.fine.net"]["bad_share"] < rep["few.site.org"]["bad_share"] < 1
    assert url_filter.reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    df = pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    copies = collections.defaultdict(list)
    for i, payload in rows:
        if len(payload) >= 1000:
            copies[payload].append(i)
    want = collections.Counter()
    for i, payload in rows:
        last = max((x for x in copies[payload] if x is not None), default=None)
        again = len(copies[payload]) > 1 and i != last
        want[i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None] += 1
    got = warc.archive_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_warc_files_and_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    folder = f"file://{tmp_path}/warc"
    places = warc.write_archives(warc.with_roles(pages(spark).select("page_id", "url", "html")), folder)
    index = warc.build_index(places)
    firsts = [(r.first_key, r.first_id) for r in index.collect()]
    assert len(firsts) > 3 and len(glob.glob(f"{tmp_path}/warc/*.warc.gz")) >= 1
    wanted = spark.createDataFrame([("com,dup)/a", 102), ("com,dup)/a", 999), ("none)/", 1)], "key string, page_id long")
    found = warc.read_records(warc.locate(wanted, index), folder).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in found] == [(102, "revisit", 104)]
    full = warc.read_records(warc.locate(spark.createDataFrame([("com,dup)/a", 104)], "key string, page_id long"), index), folder).collect()
    assert {(r.page_id, r.record_type) for r in full} == {(104, "response")} and all(r.payload_digest == r.stated_digest for r in full)


def water(sizes):
    """Targets by sharing again and again, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, full = sum(sizes.values()), dict.fromkeys(order, 0.0), set()
    left = float(total)
    while left > 1e-9 * max(1, total):
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        if not w:
            break
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in open_:
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target


def test_mixing(spark):
    rows = documents()
    mixed = mixing.mix(frame(spark, rows).drop("size", "note").select("doc_id", "source", "text")).collect()
    size = {i: len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) - sum(x == "" for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ")) for i, t, *_ in rows}
    sizes = collections.Counter()
    for i, t, _, s, *_ in rows:
        sizes[s] += size[i]
    want = water(dict(sizes))
    taken = collections.Counter()
    for r in mixed:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    largest = {s: max(size[i] for i, _, _, t, *_ in rows if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    order = mixing.training_order(mixing.mix(frame(spark, rows).drop("size").select("doc_id", "source", "text", "note")))
    positions = [r["position"] for r in order.collect()]
    assert positions == sorted(positions) and len(positions) == sum(r["copies"] for r in mixed)
    assert mixing.mix(frame(spark, []).drop("size")).count() == 0


def test_curriculum_follows_the_schedule(spark):
    """Half of what a source gives is given by the time at which the integral of its weight is half."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(10).cast("long").alias("size"))
    placed = mixing.mix(df).withColumn("p", F.explode("positions")).groupBy("source").agg(
        F.avg((F.col("p") < 0.5).cast("double")).alias("early"), F.count("*").alias("n")
    )
    early = {r.source: r.early for r in placed.collect()}
    # t + g t (1 - t) at one half is 1/2 + g/4.
    assert early["s0"] == pytest.approx(0.625, abs=0.01)
    assert early["s1"] == pytest.approx(0.5, abs=0.01) and early["s2"] == pytest.approx(0.375, abs=0.01)


def test_curve_visits_neighbours(spark):
    """Successive cells of a Hilbert curve differ by one step in one dimension, and every cell comes once."""
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        n = 1 << (axes * bits)
        cells = spark.range(n).select(*[F.shiftright("id", bits * k).bitwiseAND((1 << bits) - 1).alias(f"a{k}") for k in range(axes)])
        rows = hilbert.curve_index([F.col(f"a{k}") for k in range(axes)], bits, cells).orderBy("curve").collect()
        assert [r["curve"] for r in rows] == list(range(n))
        points = np.array([[r[f"a{k}"] for k in range(axes)] for r in rows])
        assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    import zlib

    rows = documents() + [(1000 + i, "copy", "en", "s1", 4, None, None) for i in range(500)]
    out = hilbert.hilbert_shards(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    counts = collections.Counter(r["shard"] for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in out)
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    few = hilbert.hilbert_shards(frame(spark, rows[:3])).collect()
    assert len({r["shard"] for r in few}) == 3
    assert hilbert.hilbert_shards(frame(spark, [])).count() == 0


def shard_rows():
    rng = np.random.default_rng(9)
    rows = documents() + [(1000 + i, "copy", "en", f"s{i % 3}", 4, None, None) for i in range(300)]
    for i in range(400):
        rows.append((2000 + i, "t" * int(rng.integers(1, 400)) if i % 4 else f"shared {i % 12}", "defr"[i % 3 :][:2], f"src{i % 9}", 1, None, None))
    return rows


def test_shards_equal_brute_force(spark):
    """Cell, rank and slot of every row made anew in plain Python; only a boundary cuts equal texts."""
    import zlib

    rows = shard_rows()
    out = hilbert.placed(frame(spark, rows)).collect()
    held = collections.defaultdict(list)
    for i, t, lang, source, *_ in rows:
        held[(t or "").encode()].append((i is None, i if i is not None else 0, source, lang, i))
    first = {}
    for raw, members in held.items():
        # Nulls sort first within equal ids.
        _, _, source, lang, i = min(members, key=lambda m: (m[0], m[1], m[2] is not None, m[2] or "", m[3] is not None, m[3] or ""))
        first[raw] = (source, lang, len(raw) + 1, i)

    def text_levels(k):
        values = sorted({f[k] for f in first.values() if f[k] is not None}) + ([None] if any(f[k] is None for f in first.values()) else [])
        return {v: min(15, j * 16 // max(len(values), 16)) for j, v in enumerate(values)}

    def cuts(k):
        values = sorted(f[k] for f in first.values() if f[k] is not None)
        return sorted({values[max(0, int(np.ceil(j / 16 * len(values))) - 1)] for j in range(1, 16)})

    by_text, by_cut = {k: text_levels(k) for k in (0, 1)}, {k: cuts(k) for k in (2, 3)}
    cell = {
        raw: (by_text[0][f[0]], by_text[1][f[1]], *[0 if f[k] is None else sum(f[k] >= c for c in by_cut[k]) for k in (2, 3)])
        for raw, f in first.items()
    }
    names = [f"a{k}" for k in range(4)]
    cells = spark.createDataFrame([[int(x) for x in c] for c in set(cell.values())], names)
    curve = {tuple(r[n] for n in names): r["curve"] for r in hilbert.curve_index([F.col(n) for n in names], 4, cells).collect()}
    order = sorted(held, key=lambda raw: (curve[cell[raw]], hashlib.md5(raw).hexdigest()))
    n, rank, want = len(rows), 0, {}
    for raw in order:
        want[hashlib.md5(raw).hexdigest()] = (curve[cell[raw]], set(range(rank, rank + len(held[raw]))))
        rank += len(held[raw])
    starts = [-(-s * n // 16) for s in range(16)]
    got = collections.defaultdict(set)
    for r in out:
        assert r["curve"] == want[r["digest"]][0]
        got[r["digest"]].add(starts[r["shard"]] + r["slot"])
    assert got == {d: ranks for d, (_, ranks) in want.items()}
    assert sum(len({r["shard"] for r in out if r["digest"] == d}) > 1 for d in want) <= 15
    assert {r["text_crc32"] for r in out} == {zlib.crc32(raw) for raw in held}


def test_written_shards_are_pruned(spark, tmp_path):
    rows = shard_rows()
    docs = frame(spark, rows)
    hilbert.write_shards(docs, str(tmp_path / "out"))
    assert spark_rows(spark.read.parquet(str(tmp_path / "out/data")).select(*docs.columns)) == spark_rows(docs)
    every = len(set(hilbert.read_shards(spark, str(tmp_path / "out")).inputFiles()))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    for name, bounds, value in (
        ("source", ("src1", "src1"), F.col("source")), ("lang", ("fr", "fr"), F.col("lang")), ("size", (1, 12), size),
        ("size", (300, 400), size), ("doc_id", (2390, 2399), F.col("doc_id")),
    ):
        found = hilbert.read_shards(spark, str(tmp_path / "out"), **{name: bounds})
        assert spark_rows(found.select(*docs.columns)) == spark_rows(docs.where(value.between(*bounds)))
        read = {f.split("shard=")[1].split("/")[0] for f in found.inputFiles()}
        assert 0 < len(read) < 16 <= every, name


def test_domains_of_hosts(spark):
    table = ("co.uk", "a.b.example", "*.ck", "!www.ck", "*.compute.test")
    want = {
        "www.example.com": ("example.com", "com"), "example.com.": ("example.com", "com"), "u:p@shop.example.com:8080": ("example.com", "com"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "99.1.0.1:80": ("99.1.0.1", "99.1.0.1"), "[::1]:443": ("[::1]", "[::1]"),
        "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""),
        "p.q.a.b.example": ("q.a.b.example", "a.b.example"), "b.example": ("b.example", "example"), "m.n.o.ck": ("n.o.ck", "o.ck"),
        "www.ck": ("www.ck", "ck"), "x.www.ck": ("www.ck", "ck"), "z.eu.compute.test": ("z.eu.compute.test", "eu.compute.test"), "1.2.3.4.5": ("4.5", "5"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string").withColumn("name", url_filter.server(F.col("host")))
    got = df.select("host", url_filter.domain(F.col("name"), table), url_filter.suffix(F.col("name"), table)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_the_method_blocks_and_lets_through(spark):
    """Hosts with many bad pages are blocked, by their own pages or their domain's; few pages do not block; rules win."""
    def pages(host, n, bad):
        return [(f"http://{host}/p{k}", int(k < bad)) for k in range(n)]

    outcomes = pages("spam.bad.co.uk", 200, 195) + pages("more.bad.co.uk:81", 200, 190) + pages("good.net", 300, 3) + pages("fine.org", 300, 2)
    outcomes += pages("mixed.org", 100, 50) + [("http://spam.bad.co.uk/null", None)] + pages("10.0.0.1", 80, 80) + pages("99.1.0.1", 80, 0)
    urls = ["http://spam.bad.co.uk/x", "http://new.bad.co.uk/", "http://good.net/", "http://mixed.org/", "http://unknown.net/", "http://10.0.0.1/", "http://99.1.0.1/", None, "http://spam.bad.co.uk/x"]
    known = spark.createDataFrame(outcomes, "url string, bad int")
    asked = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, note string, n int")
    got = {r.page_id: r.verdict for r in url_filter.judge(asked, known, rules=()).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block"}
    ruled = url_filter.judge(asked, known, rules=(("allow", "co.uk/x"),)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in ruled if r.page_id < 2} == {0: ("co.uk/x", "allow"), 1: (None, "block")}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns, want = check_rows(connect(sf), CHECKS[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


def test_warc_records_give_back_the_url(spark, tmp_path):
    urls = ["http://Www.Example.com/A?b#c", "https://www.example.com/A?b#c", "http://é.example/x\r\nWARC-Type: y", None]
    want = ["http://Www.Example.com/A?b#c", "https://www.example.com/A?b#c", "http://é.example/x%0D%0AWARC-Type: y", ""]
    df = spark.createDataFrame([(k, u, f"<p>{k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    places = warc.write_archives(warc.with_roles(df), f"file://{tmp_path}/warc").collect()
    assert len(places) == 4
    for r in places:
        with open(f"{tmp_path}/warc/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            fields, payload = warc.parsed(gzip.decompress(f.read(r["length"])))
        assert fields["WARC-Target-URI"] == want[r["page_id"]] and fields["WARC-Type"] == "response"
        assert payload == f"<p>{r['page_id']}".encode()
