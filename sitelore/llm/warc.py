"""WARC archives: written in tasks, read back by verified record boundaries.

Reading does not trust a record's first bytes, as a payload may hold them too. Tasks scan
byte ranges for candidate records and emit, for each, the offset where its successor must
start. Inside a range the candidates are followed to the first offset beyond it. Pointer
jumping over these exits then doubles the distance walked from the start of each file, and
only candidates on the chain from there are records.

Two layouts: plain records, and one gzip member per record whose extra field `sl` holds the
compressed and the plain length, so that a successor is known without inflating.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import new_folder, read_range, whole_texts, write_file
from sitelore.session import materialize

# fixed values of the formats
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"

LEAST_REVISIT = 100  # shorter payloads are always stored
HEADER_BYTES = 1 << 16  # a header must end within this of its record's start
FILES = "file string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _line(text: str | None) -> str:
    """A header value on one line."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One plain WARC record: a response, or a revisit when `refers_to` names a page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {_line(url)}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own and its plain length in the extra field `sl`."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(GZIP_HEAD) + 8 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP_HEAD + struct.pack("<II", size, len(data) & 0xFFFFFFFF) + body + tail


def write_archives(
    pages: DataFrame, folder: str, file_bytes: int = 256 << 20, compress: bool = True
) -> DataFrame:
    """Write a record per row of `pages` (`page_id`, `url`, `html`); one `FILES` row per file.

    Of rows with equal payloads of at least `LEAST_REVISIT` bytes, those with the smallest
    page_id are responses and the others revisit it; a repeated row repeats its record. Null
    page_ids come last and are never referred to unless no copy has one. Null html is empty.
    A file is closed when it passes `file_bytes`; an empty table writes no file.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = whole_texts(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"),
    )
    # one row per payload, combined before the shuffle
    first = (
        rows.where(F.octet_length("html") >= LEAST_REVISIT)
        .groupBy("digest").agg(F.min("page_id").alias("first_id"))
    )
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    linked = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("first_id")).alias("refers_to")
    )

    def write(batches):
        attempt = TaskContext.get()
        stem = f"part-{attempt.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        made, held, size = [], [], 0

        def flush():
            name = f"{stem}-{len(made):05d}.warc" + (".gz" if compress else "")
            write_file(folder, name, held)
            made.append((name, size, len(held)))

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                data = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                data = gzip_member(data) if compress else data
                if held and size + len(data) > file_bytes:
                    flush()
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            flush()
        cols = list(zip(*made)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
            ["file", "bytes", "records"],
        )

    return materialize(linked.mapInArrow(write, FILES), "archives")


def candidates(data: bytes, start: int, stop: int, whole: int) -> list[tuple[int, int]]:
    """(offset, successor) of all candidates that start in `data` before `stop`.

    `data` begins at byte `start` of a file of `whole` bytes and goes on beyond `stop`, so
    that headers are complete. A candidate whose header does not parse or whose end lies
    beyond the file is none.
    """
    found = []
    for magic, successor in ((GZIP_HEAD, _gzip_end), (VERSION, _plain_end)):
        at = data.find(magic)
        while 0 <= at < stop - start:
            end = successor(data, at)
            if end is not None and start + end <= whole:
                found.append((start + at, start + end))
            at = data.find(magic, at + 1)
    return sorted(found)


def _gzip_end(data: bytes, at: int) -> int | None:
    lengths = data[at + len(GZIP_HEAD) : at + len(GZIP_HEAD) + 4]
    size = struct.unpack("<I", lengths)[0] if len(lengths) == 4 else 0
    return at + size if size > len(GZIP_HEAD) + 16 else None


def _plain_end(data: bytes, at: int) -> int | None:
    end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        return None
    value = _header(data[at:end]).get("content-length", "")
    return end + 4 + int(value) + 4 if value.isascii() and value.isdigit() else None


def _header(data: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def local_exits(pairs: list[tuple[int, int]], stop: int) -> dict[int, int]:
    """Each candidate's first offset at or beyond `stop` along the chain, or a dead end inside."""
    exits: dict[int, int] = {}
    for at, nxt in reversed(pairs):
        exits[at] = exits.get(nxt, nxt)
    return exits


def byte_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """file, bytes, first, stop: one row per range."""
    last = F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1)) - 1
    return files.select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k")
    ).select(
        "file", "bytes", (F.col("k") * range_bytes).alias("first"),
        F.least((F.col("k") + 1) * range_bytes, F.col("bytes")).alias("stop"),
    )


def scan_candidates(ranges: DataFrame, folder: str) -> DataFrame:
    """file, first, stop, offset, successor, exit of every candidate in every range."""

    def scan(batches):
        for batch in batches:
            for name, size, first, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = read_range(folder, name, first, stop - first + HEADER_BYTES)
                pairs = candidates(data, first, stop, size)
                exits = local_exits(pairs, stop)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([name] * len(pairs), pa.string()),
                        "offset": pa.array([a for a, _ in pairs], pa.int64()),
                        "successor": pa.array([b for _, b in pairs], pa.int64()),
                        "exit": pa.array([exits[a] for a, _ in pairs], pa.int64()),
                    }
                )

    return ranges.mapInArrow(scan, "file string, offset long, successor long, exit long")


def chain_entries(found: DataFrame, hops: int) -> DataFrame:
    """file, offset of the candidates where the chain from byte 0 enters a byte range.

    `hops`: at least the most ranges of a file. After k rounds the chain is known 2^k
    ranges far and every pointer spans 2^k ranges.
    """
    reached = found.where("offset = 0").select("file", "offset")
    jumps = found.select("file", "offset", F.col("exit").alias("target"))
    for _ in range(max(0, hops - 1).bit_length()):
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("target").alias("offset"))
        on_file = step.join(found.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = materialize(reached.unionByName(on_file).distinct(), "reached")
        ahead = jumps.select("file", F.col("offset").alias("target"), F.col("target").alias("far"))
        jumps = materialize(
            jumps.join(ahead, ["file", "target"]).select("file", "offset", F.col("far").alias("target")), "jumps"
        )
    return reached


def read_archives(files: DataFrame, folder: str, range_bytes: int = 4 << 20) -> DataFrame:
    """`RECORDS` rows of the verified records of all files.

    Payload length and digest of a response are computed from the bytes read and must agree
    with its header; a revisit's come from its header. A file whose chain does not
    end at its last byte raises an error.
    """
    ranges = byte_ranges(files, range_bytes)
    found = materialize(scan_candidates(ranges, folder), "candidates")
    most = files.agg(F.max("bytes")).first()[0] or 0
    entries = chain_entries(found, -(-most // range_bytes))
    whole = entries.join(found, ["file", "offset"]).join(files, "file").where("exit = bytes")
    if whole.select("file").distinct().count() != files.count():
        raise ValueError(f"{folder}: a file's records do not reach its end")
    starts = entries.join(files.select("file", "bytes"), "file").select(
        "file", "bytes", "offset",
        F.least((F.floor(F.col("offset") / range_bytes) + 1) * range_bytes, F.col("bytes")).alias("stop"),
    )

    def read(batches):
        for batch in batches:
            for name, size, at, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows = list(_records(folder, name, size, at, stop))
                cols = list(zip(*rows)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return starts.repartition(max(1, starts.count()), "file", "offset").mapInArrow(read, RECORDS)


def _records(folder: str, name: str, size: int, at: int, stop: int):
    """Records of the chain that start from `at` before `stop`."""
    data = read_range(folder, name, at, stop - at + HEADER_BYTES)
    base, chain = at, {}
    for a, b in candidates(data, at, stop, size):
        chain[a] = b
    while at < stop:
        if at not in chain:
            raise ValueError(f"{name}: no record at {at}")
        end = chain[at]
        part = data[at - base : end - base]
        if len(part) < end - at:  # the last record goes on in the next range
            part += read_range(folder, name, at + len(part), end - at - len(part))
        yield _parse(part)
        at = end


def _parse(data: bytes):
    if data.startswith(GZIP_HEAD):
        data = zlib.decompress(data, 31)
    cut = data.index(b"\r\n\r\n")
    head = _header(data[:cut])
    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
    length = int(head["warc-payload-length"])
    if kind == "response":
        block = data[cut + 4 : -4]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a record's payload differs from its header")
    page, refers = head["warc-page-id"], head.get("warc-refers-to-page")
    return (int(page) if page else None, length, digest, kind, int(refers) if refers else None)


def archive_round_trip(pages: DataFrame, compress: bool = True) -> DataFrame:
    """Write archives of all pages and read them back."""
    folder = new_folder(pages.sparkSession, "archives")
    files = write_archives(pages, folder, compress=compress)
    return read_archives(files, folder)
