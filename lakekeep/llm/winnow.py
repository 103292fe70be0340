"""Document fingerprints by winnowing.

A text is taken as a row of units: runs of up to 16 code points other than
white space, and of a longer run every 16 consecutive code points, one unit beginning
at each, so that units do not depend on where in the run a passage stands. Every k consecutive units are hashed; of every w consecutive
hashes the smallest is kept, the rightmost of equal ones, with its position. Two
texts that share a run of w + k - 1 units share at least one kept hash, and no match
below k units is ever reported. Likeness is the Jaccard similarity of the kept hashes.

All work is done by built-in expressions: a hash and its position are one
number, ordered by hash and then from the right, so a window's choice is a minimum.

The next document is found without an order over all rows: quantiles of the ids
cut them into ranges, each range is ordered by itself, and the first row of a range
is handed to the range before as well.

Defined results: null texts count as empty; an empty or blank text has an empty
fingerprint; fewer than k units are hashed as one; two empty fingerprints are
alike (1), an empty and another are not (0). Rows with equal ids follow each
other by size and text, null ids come first; the last row is followed by the first, a single row by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.llm.common import let, only

#: A whole run of up to 16 code points, or 16 code points of a longer one; a match moves on by the run or by one code point.
SOLID = r"[^\x20\x09-\x0D]"
SHORT = rf"(?<!{SOLID}){SOLID}{{1,16}}+(?!{SOLID})"
UNIT = rf"(?=({SHORT}|{SOLID}{{16}}))(?:{SHORT}|{SOLID})"
K, WINDOW = 5, 8
#: Rows of one id range, and ranges at most.
RANGE_ROWS, RANGES = 5000, 4096
LAST = (1 << 31) - 1


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The kept (hash, position) pairs as numbers: 32 bits of hash, then 31 bits that fall with the position."""

    def numbered(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31) + (LAST - i))

    def grams(units: Column) -> Column:
        count = F.size(units) - (k - 1)
        hashes = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(k)])
        )
        return F.when(count > 0, hashes).when(F.size(units) > 0, F.array(F.xxhash64(units))).otherwise(F.array().cast("array<bigint>"))

    def kept(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values) - (window - 1), F.lit(1)))
        chosen = F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice(values, s, F.lit(window)))))
        return F.when(F.size(values) > 0, chosen).otherwise(values)

    hashed = lambda units: F.transform(units, lambda u: F.xxhash64(u))
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(1))
    return let(units, lambda u: let(hashed(u), lambda h: let(grams(h), lambda g: let(numbered(g), kept))))


def fingerprint_text(kept: Column) -> Column:
    """hash:position of every kept gram, by position."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 31))), F.lit(":"), (LAST - v.bitwiseAND(F.lit(LAST))).cast("string"))
    return F.array_join(F.transform(kept, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes in two lists of kept grams."""
    hashes = lambda kept: F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, 31)))

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return let(both, lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / F.greatest(F.size(x) + F.size(y) - n, F.lit(1))))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` (with doc_id and text) plus next_<column> of the row that follows by ascending doc_id."""
    ids = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least"),
    ).first()
    ranges = min(RANGES, ids["n"] // RANGE_ROWS)
    cuts: list[int] = []
    if ranges > 1 and ids["known"]:
        shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
        found = docs.agg(F.percentile_approx("doc_id", shares).alias("q")).first()["q"]
        cuts = sorted({q for q in found if q > ids["least"]})
    limits = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    own = F.coalesce(F.size(F.filter(limits, lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    first = F.col("doc_id").isNull() if ids["known"] < ids["n"] else F.coalesce(F.col("doc_id") == F.lit(ids["least"]), F.lit(False))
    place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    starts = F.coalesce(F.array_contains(limits, F.col("doc_id")), F.lit(False)) if cuts else F.lit(False)
    nowhere = F.array().cast("array<struct<range:int,guest:boolean>>")
    places = F.concat(
        F.array(place(own, False)),
        F.when(starts, F.array(place(own - 1, True))).otherwise(nowhere),
        F.when(first, F.array(place(F.lit(len(cuts)), True))).otherwise(nowhere),
    )
    placed = docs.withColumn("_place", F.explode(places))
    order = Window.partitionBy("_place.range").orderBy(
        "_place.guest", F.col("doc_id").asc_nulls_first(), F.char_length("text"), F.xxhash64("text")
    )
    led = placed.select(*docs.columns, "_place", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_place.guest")).drop("_place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    The edited text has its last half of code points replaced by the first as many of the next document.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("kept", winnowed(F.col("text")))
    led = with_next(docs, ["text", "kept"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    led = led.withColumn("edited", edited).withColumn("edited_kept", winnowed(F.col("edited")))
    return led.select(
        "doc_id", "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("kept")).alias("fingerprint"), fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )
