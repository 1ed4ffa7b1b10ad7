"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of the
squared piece lengths, which is what block-diagonal attention pays). Pieces go largest
first into the open sequence that fits under every capacity and scores best, either by
the smallest weighted norm of what would be left or by the largest weighted dot product
of the piece and what is left.

Documents of more than `tokens` ids are cut into full pieces; a full piece is a sequence
by itself. All other pieces are dealt at random, by hash, into groups of about
`group_pieces`; one task packs one group, so memory is bounded and only the few last
sequences of a group can stay open.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import whole_texts
from sitelore.llm.runs import small_batches
from sitelore.llm.tokens import SLICE_TEXTS, encoder
from sitelore.session import materialize

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """Most tokens, documents and attention cost of one sequence."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype="float64")

    def longest(self) -> int:
        """Longest piece that one sequence holds under every capacity."""
        return int(min(self.tokens, np.sqrt(self.attention)))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int) -> DataFrame:
    """`PIECES` rows of documents with `doc_id` and `text`.

    Null and empty texts have the end id alone. Rows with the same `doc_id` are different
    documents (`copy` tells them apart); a null `doc_id` stays null.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer).encode_many
        for batch in small_batches(batches, SLICE_TEXTS):
            cols: list[list] = [[] for _ in range(6)]
            doc_ids, copies, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, copy, encoded in zip(doc_ids, copies, encode(texts)):
                ids = memoryview(encoded + end)
                for piece, at in enumerate(range(0, len(ids) // 4, longest)):
                    part = ids[4 * at : 4 * (at + longest)]
                    row = (doc, copy, piece, at, len(part) // 4, zlib.crc32(part))
                    for col, value in zip(cols, row):
                        col.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    rows = whole_texts(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("copy"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(cut, PIECES)


def best_fit(
    lengths: np.ndarray,
    capacity: Capacity,
    score: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; no piece is longer than `capacity.longest()`.

    `score` "norm": smallest weighted norm of the residual after placing. "dot": largest
    weighted dot product of piece and residual. Ties go to the oldest sequence.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"unknown score {score}")
    full, w = capacity.vector(), np.asarray(weights, dtype="float64")
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
    left = np.empty((3, 64))  # residual capacities of the open sequences
    number, used = np.empty(64, dtype="int64"), np.empty(64, dtype="int64")
    count = made = 0
    least = np.array([lengths.min(), 1.0, float(lengths.min()) ** 2]) if n else full
    for i in np.argsort(-lengths, kind="stable"):
        item = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        at = -1
        if count:
            rest = left[:, :count] - item[:, None]
            fits = np.flatnonzero(rest.min(axis=0) >= 0)
            if len(fits):
                if score == "norm":
                    value = (w[:, None] * (rest[:, fits] / full[:, None]) ** 2).sum(axis=0)
                else:
                    value = -((w * item / full)[:, None] * (left[:, fits] / full[:, None])).sum(axis=0)
                at = fits[value.argmin()]
        if at < 0:
            if count == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                number, used = np.concatenate([number] * 2), np.concatenate([used] * 2)
            at = count
            left[:, at], number[at], used[at] = full, made, 0
            count, made = count + 1, made + 1
        bins[i], offsets[i] = number[at], used[at]
        used[at] += lengths[i]
        left[:, at] -= item
        if (left[:, at] < least).any():  # nothing fits any more: close it, keep the order of the rest
            left[:, at : count - 1] = left[:, at + 1 : count]
            number[at : count - 1], used[at : count - 1] = number[at + 1 : count], used[at + 1 : count]
            count -= 1
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: Capacity = Capacity(),
    score: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    group_pieces: int = 20_000,
) -> DataFrame:
    """`PACKED` rows, one per piece of every document (see `token_pieces` for odd rows).

    An empty table gives no rows. Extra columns of `docs` are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity.longest()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("long")
    )

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "copy", "piece"], kind="stable")
        number, offset = best_fit(frame["length"].to_numpy(), capacity, score, weights)
        frame["sequence_id"] = frame["grp"] * (1 << 32) + number
        frame["offset"] = offset
        return frame[[c.split()[0] for c in PACKED.split(", ")]]

    return dealt.groupBy("grp").applyInPandas(pack, PACKED)
