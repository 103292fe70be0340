"""WARC archives with a two-level capture index.

Every page becomes one WARC record in a gzip member of its own. Of records with
equal payloads of at least `REVISIT_BYTES`, the one with the largest page_id is
the response and the others are revisits that refer to it.

The index has two levels. Level one: one line for each record (URL key with the host
reversed, page_id, file, offset, length), sorted by key, cut into blocks, each compressed. Level two: a
sparse directory with the first key of every block. A look-up bisects the
directory, then the block that it names, and reads that range of the archive
alone. Blocks grow with the table, so the directory never has more than about `DIRECTORY` entries
and may be broadcast.

Archives are written by the tasks through the file system that the shared folder's
address names; the rows that tell where records lie are stored by Spark, so a task that
is run again leaves at most a file that nothing refers to.

Defined results: a null html is an empty payload, a null url an empty key; rows with the
page_id of a response and an equal payload are responses as well; rows without a page_id revisit one
that has it. Every row gets a record; repeated rows get one each.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekeep.llm.common import broadcast, only, ship, stored
from lakekeep.session import work_path

REVISIT_BYTES = 1000
#: A file is closed when it has reached this size.
FILE_BYTES = 1 << 30
#: Lines of an index block at least, and blocks at most.
BLOCK_LINES, DIRECTORY = 2048, 65536
#: Fixed value: the date of all records, so that a task that is run again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1


def url_key(url: Column) -> Column:
    """com,example,www)/path?query in lower-cased ASCII host form, for sorting by domain."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    return F.regexp_replace(key, r"[\x00-\x20]", "_")


CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, key, url, payload (binary), digest, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", url_key(F.col("url")).alias("key"), "url", payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Without the payloads: only payloads that occur more than once have a row here.
    copied = pages.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(
        F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    copied = stored(copied.where("_n > 1").drop("_n"), "warc-copied")
    placed = pages.join(copied, ["digest", "size"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return placed.select(
        "page_id", "key", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def target(url: str | None) -> str:
    """The page's URL as it is, but for control characters, which no header line can hold: these are percent-encoded."""
    return CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write records to gzipped archives below `folder`; page_id, key, file, offset and length of each, stored."""
    ship()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = batch.to_pydict()
            places: list[tuple[str, int, int]] = []
            for values in zip(*(rows[c] for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(*values), LEVEL, mtime=0)
                out.write(member)
                places.append((name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([p[0] for p in places], pa.string()),
                    pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.int64()),
                ],
                names=["page_id", "key", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return stored(pages.mapInArrow(run, "page_id long, key string, file string, offset long, length long"), "warc-places")


def build_index(places: DataFrame) -> DataFrame:
    """Level one: first_key, first_id and the compressed lines of every block, sorted by key then page_id; stored."""
    ship()
    lines = max(BLOCK_LINES, -(-places.count() // DIRECTORY))
    ordered = places.withColumn("id", F.coalesce("page_id", F.lit(-(1 << 63)))).repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join(" ".join(map(str, r)) for r in rows)
            return pa.RecordBatch.from_pydict({"first_key": [rows[0][0]], "first_id": [rows[0][1]], "lines": [zlib.compress(text.encode(), LEVEL)]})

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    return stored(ordered.select("key", "id", "file", "offset", "length").mapInArrow(run, "first_key string, first_id long, lines binary"), "warc-index")


def locate(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """file, offset and length of every record with a wanted (key, page_id)."""
    directory = sorted((r["first_key"].encode(), r["first_id"]) for r in index.select("first_key", "first_id").toLocalIterator())
    level_two = broadcast(directory)

    def to_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = level_two.value
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            last = [bisect.bisect_right(firsts, (k.encode(), i)) - 1 for k, i in zip(keys, ids, strict=True)]
            # Equal keys and ids may go on over several blocks that begin with them.
            first = [max(0, bisect.bisect_left(firsts, (k.encode(), i)) - 1) for k, i in zip(keys, ids, strict=True)]
            pairs = [(n, b) for n, (f, t) in enumerate(zip(first, last, strict=True)) for b in range(f, t + 1)]
            take = pa.array([n for n, _ in pairs], pa.int64())
            starts = [firsts[b] for _, b in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take),
                    pa.array([s[0].decode() for s in starts], pa.string()), pa.array([s[1] for s in starts], pa.int64()),
                ],
                names=["key", "id", "first_key", "first_id"],
            )

    def in_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [line.rsplit(" ", 4) for line in zlib.decompress(packed).decode().split("\n")]
                sorts = [(k.encode(), int(i)) for k, i, *_ in lines]
                found: list[list[str]] = []
                for want in wants:
                    pair = (want["key"].encode(), want["id"])
                    at = bisect.bisect_left(sorts, pair)
                    while at < len(sorts) and sorts[at] == pair:
                        found.append(lines[at][2:])
                        at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([int(f[1]) for f in found], pa.int64()), pa.array([int(f[2]) for f in found], pa.int64())],
                    names=["file", "offset", "length"],
                )

    asked = wanted.select("key", F.coalesce("page_id", F.lit(-(1 << 63))).alias("id")).distinct()
    asked = asked.mapInArrow(to_block, "key string, id long, first_key string, first_id long")
    # Look-ups of one block, in lists of bounded length.
    part = F.pmod(F.xxhash64("key", "id"), F.lit(64))
    lists = asked.groupBy("first_key", "first_id", part.alias("part")).agg(F.collect_list(F.struct("key", "id")).alias("wants"))
    # Blocks that begin alike are one too many to tell apart by their first line; each is looked through.
    return lists.join(index, ["first_key", "first_id"]).select("lines", "wants").mapInArrow(in_block, "file string, offset long, length long").distinct()


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Fields and payload size and digest of the records at these places, each read as a range of its file."""
    ship()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "stated_digest", "record_type", "refers_to")}
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{root}/{file}")
                source.seek(offset)
                fields, payload = parsed(gzip.decompress(source.read(length)))
                number = lambda field: int(v) if (v := fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: E731, B023
                out["page_id"].append(number("WARC-Record-ID"))
                out["payload_bytes"].append(len(payload))
                out["payload_digest"].append(hashlib.sha1(payload).hexdigest())
                out["stated_digest"].append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                out["record_type"].append(fields["WARC-Type"])
                out["refers_to"].append(number("WARC-Refers-To"))
            yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)
        if source is not None:
            source.close()

    # Stretches of 64 MB of a file go to one task, in the order in which they lie there.
    spread = places.withColumn("stretch", F.shiftright("offset", 26)).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return spread.select("file", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long"
    )


SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, look every page up in the index, and read its record back.

    A revisit has the size and digest of the response that it refers to.
    """
    pages = only(pages, "page_id", "url", "html")
    folder = work_path(pages.sparkSession, "warc")
    places = write_archives(with_roles(pages), folder)
    index = build_index(places)
    wanted = pages.select("page_id", url_key(F.col("url")).alias("key"))
    records = stored(read_records(locate(wanted, index), folder), "warc-records")
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    full = own.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    again = again.join(full, ["refers_to", "stated_digest"], "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return own.unionByName(again)
