"""Secret scan: fixed patterns, and a battery of randomness tests on encoded-looking tokens.

Base kinds are `assign` (a named credential that is given a value), `access`
(access key ids) and `hex` (long hexadecimal runs). The battery adds the kind
`random`. Its candidates are runs of token characters from 20 up whose make-up
says which encoding they would be in: hexadecimal, base 32 or base 64. Under
that encoding a random token has uniform characters, so three tests follow:

* chi-squared of the characters' counts against a uniform alphabet,
* the number of runs above and below the middle of the alphabet,
* serial correlation of neighbouring characters' places in the alphabet.

Each gives a normal score; the largest in size, taken for three tests, is the
p-value of "random". Ordinary tokens gather near 0, random ones are uniform. What the
tests can tell depends on the length, so false discovery is controlled for each
encoding and length class over the different tokens of the whole corpus: the share of p-values above
one half estimates how many candidates are random, and a class takes
the smallest threshold at which, of what passes, at most the allowed share is not. Classes of few
tokens are pooled with neighbouring lengths, then encodings, until the estimate rests on enough.

All work is done by built-in expressions. The spans of a text come from its
pieces between matches, so positions count code points.

Defined results: null texts count as empty and have no spans; equal texts have
equal spans; spans of different kinds may overlap; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.common import let, stored

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8

#: Runs of token characters that hold a digit and a letter, wherever in the run.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "b36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "B36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Matches of a text that are folded together.
SLICE = 256
#: p-values are counted in so many equal bins; a threshold is one of the first of them.
BINS, FALSE_SHARE = 100, 0.1
LEAST_P = 0.01
#: Different tokens from LEAST_P up that an estimate of the random ones rests on.
ENOUGH = 50


def sliced(items: Column) -> Column:
    """An array in slices of SLICE, so that a fold may append to a short array and its cost stays in proportion."""
    last = F.floor((F.size(items) - 1) / SLICE).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * SLICE + 1, F.lit(SLICE)))).otherwise(F.array(items))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    Places are summed up within slices first, then over the slices.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,value:string>>"

    def walk(found: Column, gaps: Column) -> Column:
        def within(pairs: Column) -> Column:
            def step(acc: Column, pair: Column) -> Column:
                start = acc["at"] + F.char_length(pair["gap"])
                end = start + F.char_length(pair["value"])
                span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

            return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

        def shifted(parts: Column) -> Column:
            offsets = F.aggregate(
                parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                lambda acc: acc["out"],
            )
            moved = F.zip_with(parts, offsets, lambda p, o: F.transform(
                p["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"))
            ))
            return F.flatten(moved)

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return let(pairs, lambda p: let(F.transform(sliced(p), within), shifted))

    none = F.array().cast(kind)
    return F.when(F.rlike(text, F.lit(pattern)), let(found, lambda f: let(gaps, lambda g: walk(f, g)))).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end, value) of each base kind."""
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda m: F.char_length(value(m)) >= LEAST_VALUE),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def encoding(token: Column) -> Column:
    """The encoding that a token's characters are in."""
    return (
        F.when(F.rlike(token, F.lit("^[0-9a-f]+$")), "hex")
        .when(F.rlike(token, F.lit("^[0-9A-F]+$")), "HEX")
        .when(F.rlike(token, F.lit("^[A-Z2-7]+$")), "b32")
        .when(F.rlike(token, F.lit("^[0-9a-z]+$")), "b36")
        .when(F.rlike(token, F.lit("^[0-9A-Z]+$")), "B36")
        .otherwise("b64")
    )


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal Z, to five digits (a rational approximation)."""
    a = F.least(F.abs(z), F.lit(8.0))

    def tail(k: Column) -> Column:
        poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
        return 2 * poly * F.exp(-a * a / 2) / 2.5066282746310002

    return let(1 / (1 + 0.2316419 * a), tail)


def randomness(token: Column, alphabet: Column) -> Column:
    """The p-value of the three tests together for a token in its encoding's alphabet."""
    url = F.translate(token, "-_", "+/")
    codes = F.filter(
        F.transform(F.split(url, ""), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double")),
        lambda x: x >= 0,
    )
    size = F.char_length(alphabet).cast("double")

    def tests(codes: Column) -> Column:
        n = F.size(codes).cast("double")
        distinct = F.array_distinct(codes)
        counts = F.transform(distinct, lambda d: F.size(F.filter(codes, lambda c: c == d)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        chi = squares * size / n - n
        # Mean and spread of the statistic for n draws from a uniform alphabet.
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        middle = (size - 1) / 2
        high = F.transform(codes, lambda c: (c > middle).cast("int"))
        turns = F.aggregate(
            F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("int")),
            F.lit(0), lambda s, x: s + x,
        )
        z_runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        products = F.aggregate(
            F.zip_with(
                F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
                lambda a, b: (a - middle) * (b - middle),
            ),
            F.lit(0.0), lambda s, x: s + x,
        )
        z_serial = products / (F.sqrt(n - 1) * (size * size - 1) / 12)
        worst = F.greatest(F.abs(z_chi), F.abs(z_runs), F.abs(z_serial))
        return let(normal_tail(worst), lambda p: 1 - F.pow(1 - p, F.lit(3.0)))

    return let(codes, lambda c: F.when(F.size(c) >= 20, tests(c)).otherwise(0.0))


def length_class(n: Column) -> Column:
    """Lengths in steps of a quarter of an octave."""
    return F.floor(F.log2(n.cast("double")) * 4).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start, end, enc, len, p, h>> of the tokens that are tested; h tells different tokens apart."""
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])

    def tested(m: Column) -> Column:
        def with_encoding(e: Column) -> Column:
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"), e.alias("enc"),
                length_class(F.char_length(m["value"])).alias("len"),
                randomness(m["value"], F.element_at(alphabets, e)).alias("p"), F.xxhash64(m["value"]).alias("h"),
            )

        return let(encoding(m["value"]), with_encoding)

    return F.transform(matches(text, TOKEN), tested)


def binned(found: DataFrame) -> DataFrame:
    """enc, len, bin and c, the number of different tokens there: copies of a token are no further p-values."""
    bin_of = F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    different = found.select(F.explode("_tested").alias("t")).select("t.enc", "t.len", bin_of, "t.h").distinct()
    return different.groupBy("enc", "len", "bin").agg(F.count(F.lit(1)).alias("c"))


def pool(held: dict[tuple[str, int], np.ndarray], enc: str, length: int) -> tuple[np.ndarray, bool]:
    """Counts by bin that a class is judged by, and whether they are still too few.

    A class with fewer than ENOUGH different tokens from LEAST_P up takes in the lengths next to its own,
    one step to each side at a time, then all encodings of lengths near its own, likewise.
    """
    far = lambda c: abs(c[1] - length)
    for same in (True, False):
        counts = np.zeros(BINS, dtype=np.int64)
        for _, step in groupby(sorted((c for c in held if c[0] == enc or not same), key=far), key=far):
            counts = sum((held[c] for c in step), counts)
            if counts[int(LEAST_P * BINS) :].sum() >= ENOUGH:
                return counts, False
    return counts, True


def thresholds(bins: DataFrame) -> DataFrame:
    """enc, len and the p-value from which a candidate of the class is taken for random.

    `bins` has enc, len, bin and c. With m candidates of which those above one half
    suggest r = 2 c(p >= 1/2) random ones, a threshold b passes c(p >= b)
    candidates, of which r (1 - b) are expected to be random; the rest is false. A class
    where no threshold is good enough takes nothing. Thin classes are judged by their pool; random tokens
    are uniform in all of them. Where all tokens together are too few, one
    more is counted above one half, so that a lone random token is not lost by lying below it.
    """
    held: dict[tuple[str, int], np.ndarray] = {}
    # A row for each class and bin: some tens of thousands at most.
    for r in bins.collect():
        held.setdefault((r["enc"], r["len"]), np.zeros(BINS, dtype=np.int64))[r["bin"]] += r["c"]
    out = []
    for enc, length in sorted(held):
        counts, thin = pool(held, enc, length)
        r = 2 * (int(counts[BINS // 2 :].sum()) + thin)
        for b in range(int(LEAST_P * BINS), BINS // 2):
            passed = int(counts[b:].sum())
            if passed and passed - r * (1 - b / BINS) <= FALSE_SHARE * passed:
                out.append((enc, length, b / BINS))
                break
    return bins.sparkSession.createDataFrame(out, "enc string, len int, least_p double")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with `spans`: array<struct<kind, start, end>> ordered by start, then kind as listed.

    The texts are read twice: once for the candidates' counts, which the corpus-wide thresholds
    need before any token can be judged, and once for the result. Only the counts are stored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c != text]
    found = docs.select(*others, whole.alias("_text"))
    found = found.select(*others, *[c.alias(f"_{k}") for k, c in base_spans(F.col("_text")).items()], candidates(F.col("_text")).alias("_tested"))
    bins = stored(binned(found), "secret-bins")
    # One row for each encoding and quarter octave of length: some hundreds at most.
    taken = {f"{r['enc']}/{r['len']}": r["least_p"] for r in thresholds(bins).collect()}
    least = F.create_map(*[F.lit(x) for pair in sorted(taken.items()) for x in pair]) if taken else F.create_map().cast("map<string,double>")

    def numbered(found: Column, place: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("k"), m["end"].alias("end")))

    named = [numbered(F.col(f"_{k}"), place) for place, k in enumerate(KINDS[:3])]
    limit = lambda t: F.try_element_at(least, F.concat_ws("/", t["enc"], t["len"].cast("string")))
    random = numbered(F.filter("_tested", lambda t: F.coalesce(t["p"] >= limit(t), F.lit(False))), 3)
    spans = F.transform(
        F.array_sort(F.concat(*named, random)),
        lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select(*others, spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by a mark.

    Spans are taken in slices, each with its own stretch of the text, so that no span is looked for from the text's beginning.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def within(part: Column, own: Column, base: Column, at: Column) -> Column:
        """Pieces of one slice's stretch; the stretch begins at place `base`, and what lies before `at` is done with."""
        def step(acc: Column, s: Column) -> Column:
            hidden = s["start"] + 1 < acc["at"]
            kept = F.substring(own, acc["at"] - base + 1, F.greatest(s["start"] + 1 - acc["at"], F.lit(0)))
            piece = F.concat(kept, F.when(hidden, "").otherwise(mark))
            return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)

    def over(acc: Column, part: Column) -> Column:
        last = F.array_max(F.transform(part, lambda s: s["end"])) + 1
        own = F.substring(text, acc["at"], F.greatest(last - acc["at"], F.lit(0)))
        done = let(own, lambda o: within(part, o, acc["at"], acc["at"]))
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    whole = F.aggregate(
        sliced(spans), start, over,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"], F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
