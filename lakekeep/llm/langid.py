"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text is built. A text
is parsed against every automaton into the longest phrases that occur in that
language's text; the language needing the fewest normalised phrases (phrases,
times the bits that point into the training text, per byte) wins.

Text is lower-cased, each run of ASCII characters that are no letters becomes
one blank, and the parse goes over UTF-8 bytes, so the alphabet is bounded
whatever the scripts. Parsing restarts every `SEGMENT` bytes, alike for every
language, which lets numpy walk many segments of many texts at once and keeps a
very long text from holding up the others.

Defined results: null texts and texts without a letter are `und` with score 0;
ties go to the language first by code point; with no labelled text at all
every text is `und`. A score is the margin of the winner over the next language:
1 - phrases(best) / phrases(second), and 1 where only one language is known.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekeep.llm.bpe import blocks
from lakekeep.llm.common import only, ship

#: Labelled texts sampled for each language, and code points taken of each.
SAMPLED, EXCERPT = 120, 240
SEGMENT = 512
UND = "und"
#: Phrases per byte of the best language beyond which a text is none of the languages learned,
#: and the bytes from which that can be told.
FOREIGN, FOREIGN_BYTES = 0.5, 64
FRESH = np.int32(1 << 30)
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters are blanks.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def training_sample(df: DataFrame, usable: Column, sampled: int = SAMPLED, excerpt: int = EXCERPT) -> dict[str, list[str]]:
    """Excerpts of at most `sampled` different texts for each label, lowest text hash first.

    Bounded by `sampled * excerpt` code points for each language. The filter by
    hash keeps a few times the wanted number before anything is ordered; its rate
    comes from the number of different texts, as copies pass or fail together. Equal
    texts are folded before the shuffle, so a language with most rows, or
    one text with most copies, does no harm.
    """
    hashed = only(df, "text", "lang", "doc_id").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = hashed.select("lang", "text", F.xxhash64("text").alias("h"))
    # One number for each label: fewer than the sampled rows, which come to the driver as well.
    different = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in different.collect()}
    if not counts:
        return {}
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 8.0 * sampled / n * (1 << 31))])
    low = F.shiftrightunsigned("h", 33) < F.element_at(limits, F.col("lang"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.char_length("text") - excerpt)) + 1
    some = hashed.where(low).groupBy("lang", "h").agg(
        F.min(F.substring(F.col("text"), start.cast("int"), F.lit(excerpt))).alias("part")
    )
    first = Window.partitionBy("lang").orderBy("h", "part")
    rows = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sampled).select("lang", "k", "part")
    out: dict[str, list[str]] = {}
    for row in sorted(rows.collect()):
        out.setdefault(row["lang"], []).append(row["part"])
    return dict(sorted(out.items(), key=lambda x: x[0].encode()))


def normal_bytes(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes in which runs of other ASCII characters are single blanks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(PLAIN), dtype=np.uint8)
    if not raw.size:
        return raw
    blank = raw == 32
    return raw[~(blank & np.append(True, blank[:-1]))]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class CrossParser:
    """Parse tables of all languages.

    A table holds for each state and symbol the next state (times the alphabet
    size). Where the automaton has no transition, a phrase ends: the entry is
    that of the start state with FRESH added, so that a parse takes one look-up
    for each byte and counts phrases by their first bytes.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = list(samples)
        texts = [np.concatenate([normal_bytes(f" {t} ") for t in parts]) for parts in samples.values()]
        seen = np.unique(np.concatenate(texts)) if texts else np.array([], dtype=np.uint8)
        self.size = len(seen) + 1
        self.code = np.zeros(256, dtype=np.uint8)
        self.code[seen] = np.arange(1, len(seen) + 1, dtype=np.uint16).astype(np.uint8)
        self.bits = [np.log2(len(t) + 1) for t in texts]
        self.tables = [self._table(suffix_automaton(self.code[t].tolist())) for t in texts]

    def _table(self, moves: list[dict[int, int]]) -> np.ndarray:
        root = np.full(self.size, FRESH, dtype=np.int32)
        for c, q in moves[0].items():
            root[c] = FRESH + q * self.size
        table = np.tile(root, (len(moves), 1))
        for state, to in enumerate(moves):
            if state and to:
                table[state, list(to)] = np.fromiter(to.values(), np.int32, len(to)) * self.size
        return table.ravel()

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = np.maximum(1, -(-sizes // SEGMENT))
        owner = np.repeat(np.arange(len(texts)), pieces)
        first = np.cumsum(pieces) - pieces
        begin = (np.arange(len(owner)) - first[owner]) * SEGMENT
        lengths = np.minimum(SEGMENT, sizes[owner] - begin)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([*texts, np.zeros(SEGMENT, dtype=np.uint8)])
        at = (np.cumsum(sizes) - sizes)[owner[order]] + begin[order]
        symbols = self.code[flat[at + np.arange(SEGMENT)[:, None]]].astype(np.int32)
        active = np.searchsorted(-lengths[order], -np.arange(SEGMENT), side="left")
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(order), dtype=np.int32)
            count = np.zeros(len(order), dtype=np.int32)
            for t in range(SEGMENT):
                n = active[t]
                if not n:
                    break
                to = table[state[:n] + symbols[t, :n]]
                count[:n] += to >> 30
                state[:n] = to & (FRESH - 1)
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score, phrases per byte and bytes parsed of each text."""
        lettered = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        lang, score, rate, parsed = [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not lettered:
            return lang, score, rate, parsed
        symbols = [normal_bytes(texts[k]) for k in lettered]
        phrases = self.phrases(symbols)
        normalised = phrases * np.array(self.bits)
        best = normalised.argmin(axis=1)
        ranked = np.sort(normalised, axis=1)
        for row, k in enumerate(lettered):
            lang[k] = self.languages[best[row]]
            score[k] = float(1 - ranked[row, 0] / ranked[row, 1]) if len(self.languages) > 1 and ranked[row, 1] else 1.0
            parsed[k] = len(symbols[row])
            rate[k] = float(phrases[row, best[row]] / max(1, parsed[k]))
        return lang, score, rate, parsed


_parsers: dict[int, CrossParser] = {}


def parser_of(samples: dict[str, list[str]]) -> CrossParser:
    """The parse tables of this Python worker, built once from the sample."""
    key = hash(tuple((k, tuple(v)) for k, v in samples.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def foreign() -> Column:
    """Long enough to tell, and parsed like none of the languages learned."""
    return (F.col("phrase_rate") > FOREIGN) & (F.col("parsed_bytes") >= FOREIGN_BYTES)


def identify(df: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """`df` with lang_pred, score, phrase_rate and parsed_bytes in place of its text; only the text is looked at."""
    ship()
    others = [c for c in df.columns if c != text]
    schema = df.select(*others).schema.add("lang_pred", "string").add("score", "double").add("phrase_rate", "double").add("parsed_bytes", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples)
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            for start, end in blocks([t or "" for t in texts]):
                lang, score, rate, parsed = parser.predict(texts[start:end])
                kept = [batch.column(k).slice(start, end - start) for k in range(len(others))]
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(parsed, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)
            pa.default_memory_pool().release_unused()

    return df.select(*others, text).mapInArrow(run, schema)
