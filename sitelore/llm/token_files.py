"""Directly addressable token files.

A file holds the ids of consecutive documents. Ids are split into levels of `BITS` bits.
Level 0 has the lowest bits of every id; a level's continuation bitmap marks the ids that
go on, and level k + 1 holds one chunk for each mark of level k. A rank directory keeps
the number of marks before every block of `BLOCK` positions, so the chunk of any id is
found by one directory entry and one short popcount: token i is read without decoding
its neighbours.

Layout, little-endian: magic, header length, JSON header (documents, tokens, end id,
levels with their sizes), then `doc_ids` int64, `starts` int64 (documents + 1, relative
to the file), and for each level its chunks (uint8), bitmap and directory (uint32).
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.files import new_folder, read_range, whole_texts, write_file
from sitelore.llm.runs import small_batches
from sitelore.llm.tokens import SLICE_TEXTS, encoder, id_bytes
from sitelore.session import materialize

MAGIC = b"DACTOK01"
BITS = 8
BLOCK = 512
SAMPLED = 50  # keys looked at per shard to place its lower end
NO_DOC = -(2**63)  # stands for a null doc_id in a file

MANIFEST = "shard long, part long, file string, documents long, tokens long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, packed bitmap and rank directory of each level."""
    levels = []
    rest = ids
    while True:
        more = rest >> BITS
        marks = more > 0
        packed = np.packbits(marks, bitorder="little")
        blocks = np.arange(0, len(marks), BLOCK)
        ends = np.add.reduceat(marks, blocks, dtype="<u4") if len(marks) else np.empty(0, "<u4")
        ranks = np.concatenate([[0], np.cumsum(ends)]).astype("<u4")
        levels.append(((rest & ((1 << BITS) - 1)).astype("u1"), packed, ranks))
        if not marks.any():
            return levels
        rest = more[marks]


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """The parts of a file for documents whose ids follow one another in `ids`."""
    levels = _levels(ids)
    header = json.dumps(
        {
            "documents": len(doc_ids), "tokens": len(ids), "bits": BITS, "block": BLOCK,
            "levels": [[len(c), len(b), len(r)] for c, b, r in levels],
        }
    ).encode()
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    names = np.array([NO_DOC if d is None else d for d in doc_ids], dtype="<i8")
    parts = [MAGIC, struct.pack("<I", len(header)), header, names.tobytes(), starts.tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return parts


class TokenFile:
    """A file's bytes with random access to its tokens and documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        at = 12 + size
        self.bits, self.block = head["bits"], head["block"]
        self.tokens, docs = head["tokens"], head["documents"]
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<i8", docs + 1, at + 8 * docs)
        at += 8 * (2 * docs + 1)
        self.levels = []
        for n_chunks, n_bytes, n_ranks in head["levels"]:
            chunks = np.frombuffer(data, "u1", n_chunks, at)
            bitmap = np.frombuffer(data, "u1", n_bytes, at + n_chunks)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + n_chunks + n_bytes)
            self.levels.append((chunks, bitmap, ranks))
            at += n_chunks + n_bytes + 4 * n_ranks

    def token(self, i: int) -> int:
        """Token `i` by one look-up per level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.bits * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // self.block * (self.block // 8)
            before = np.frombuffer(bitmap[first : i >> 3].tobytes(), "u1")
            low = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[i // self.block]) + int(np.bitwise_count(before).sum()) + low.bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        """All ids, level by level."""
        value, where = np.zeros(self.tokens, dtype="<u4"), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if k == 0:
                value[:] = chunks
            else:
                value[where] += chunks.astype("<u4") << np.uint32(self.bits * k)
            if k + 1 < len(self.levels):
                marks = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
                where = np.flatnonzero(marks) if k == 0 else where[marks]
        return value


def _bounds(rows: DataFrame, count: int, shards: int) -> list[tuple[bool, int, int]]:
    """Lower ends of all shards but the first: every SAMPLED-th of a sample of keys, drawn by hash
    and read once. They decide which file a document is in, nothing else."""
    if shards < 2:
        return []
    every = max(1, count // (SAMPLED * shards))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "hash", F.lit(4)), F.lit(every)) == 0)
    keys = drawn.select(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), "hash")
    found = [tuple(r) for r in keys.orderBy("a", "b", "hash").collect()]
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    shard_bytes: int = 64 << 20,
    file_tokens: int = 8_000_000,
) -> DataFrame:
    """Write the ids of all documents in ascending `doc_id` order; one `MANIFEST` row per file.

    Documents are dealt to shards by ranges of (`doc_id`, hash of the text), nulls first, of
    about equal row counts, as many as `shard_bytes` of text need: one id that most rows
    repeat is many shards, too. A task streams its sorted shard and starts a new file at
    `file_tokens`. Rows with equal ids stay separate documents, in the order of their texts'
    hashes. Null texts are empty; texts of any length are encoded whole. Other columns of `docs`
    are not read, whatever their names. An empty table writes no file.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = whole_texts(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    volume, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-volume // shard_bytes))
    bounds = _bounds(rows, count, shards)
    size = id_bytes(tokenizer, end_id)  # small vocabularies travel in two bytes an id
    kind = f"<u{size}"
    end = np.array([end_id], dtype=kind).tobytes()

    def encode(batches):
        run = encoder(tokenizer, size, cache=450_000).encode_many
        for batch in small_batches(batches, SLICE_TEXTS):
            doc_ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            encoded = [ids + end for ids in run(batch.column(2).to_pylist())]
            ends = np.cumsum([0, *map(len, encoded)]).astype("<i4")
            column = pa.Array.from_buffers(
                pa.binary(), len(encoded), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(encoded))]
            )
            keys = [(d is not None, d or 0, h) for d, h in zip(doc_ids, hashes)]  # nulls first
            shard = [bisect.bisect_right(bounds, k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), batch.column(0), batch.column(1), column], ["shard", "doc_id", "hash", "ids"]
            )

    def write(batches):
        def flush(shard, part, names, arrays):
            name = f"tokens-{shard:08d}-{part:06d}.dac"
            ids = np.concatenate(arrays)
            write_file(folder, name, encode_file(names, [len(a) for a in arrays], ids))
            return (shard, part, name, len(names), len(ids))

        made, now, part, names, arrays, held = [], None, 0, [], [], 0
        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if names and (shard != now or held >= file_tokens):
                    made.append(flush(now, part, names, arrays))
                    part, names, arrays, held = part + 1, [], [], 0
                if shard != now:
                    now, part = shard, 0
                names.append(doc)
                arrays.append(np.frombuffer(ids, kind))
                held += len(arrays[-1])
        if names:
            made.append(flush(now, part, names, arrays))
        cols = list(zip(*made)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)], ["shard", "part", "file", "documents", "tokens"]
        )

    encoded = rows.mapInArrow(encode, "shard int, doc_id long, hash long, ids binary")
    # a partition is a shard: numbers are not hashed, so no two share one
    ordered = encoded.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "doc_id", "hash", "ids")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                file = TokenFile(read_range(folder, name))
                data = memoryview(file.all_tokens()).cast("B")
                starts = file.starts.tolist()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, mask=file.doc_ids == NO_DOC),
                        pa.array(file.starts[:-1] + first), pa.array(np.diff(file.starts)),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select(  # one row per file
        "shard", "part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first")
    )
    spread = starts.repartition(max(1, manifest.count()), "shard", "part")
    return spread.mapInArrow(read, DECODED)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents and read the files back."""
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
