"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.session import checkpoint_root, whole_texts  # noqa: F401


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder under the shared folder of the session."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_file(folder: str, name: str, chunks) -> None:
    """Write `chunks` as one file. It appears under its name only when complete, so a
    task that is lost or repeated leaves either nothing or the same whole file."""
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(part, f"{path}/{name}")


def read_range(folder: str, name: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes `start` to `start + length` of a file (to its end without a length)."""
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as source:
        if start:
            source.seek(start)
        return source.read() if length is None else source.read(length)


def crc32_of(text) -> F.col:
    """Unsigned crc32 of a string column's UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


def parallelism(spark: SparkSession) -> int:
    """Number of partitions that shuffles of this session are meant to have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
