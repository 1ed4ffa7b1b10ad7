"""Chunk store: parquet batches with upsert, delete and filtered reads.

A change is a new batch: its rows, and the sites whose earlier chunks it drops. Nothing that
is stored is rewritten by it. A version file lists the batches that count; it appears under
its number in one step after all data is written, so readers see a change whole or not at all, and of
two writers at once one fails. A read takes of each chunk id the latest batch's row and leaves out
what a later batch has dropped. When the later batches hold enough rows, or are many,
the live rows are written as one new batch.

Inside a batch rows are partitioned by a hash bucket of the site, not by the site itself, so
the number of folders stays fixed for any number of sites, and sorted by site, which lets
parquet statistics skip other sites. A very large site is many files of its bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sitelore.operators.retrieve import where_filter
from sitelore.operators.skew import top_per_key

BUCKETS = 256
ROWS_PER_FILE = 500_000
COMPACT_SHARE = 0.5  # of the first batch's rows in later ones: then all become one batch
COMPACT_BATCHES = 16


def _bucket() -> Column:
    return F.pmod(F.xxhash64("website_id"), F.lit(BUCKETS)).cast("int")


def flatten_metadata(chunks: DataFrame) -> DataFrame:
    """Add `flat_metadata` map<string,string>: nulls as '', nested values as JSON; the
    record's own fields win over metadata of the same name."""
    fields = chunks.select("metadata.*").schema.fields
    own = ["website_id", "source_url", "page_title", "page_type", "chunk_type", "chunk_index"]
    entries: dict[str, Column] = {}
    for f in fields:
        value = F.col("metadata")[f.name]
        nested = f.dataType.typeName() in ("array", "map", "struct")
        entries[f.name] = F.to_json(value) if nested else value.cast("string")
    for name in own:
        if name in chunks.columns:
            entries[name] = F.col(name).cast("string")
    pairs = [x for k, v in entries.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]
    return chunks.withColumn("flat_metadata", F.create_map(*pairs))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Fail on rows that cannot be stored, while they are being read."""
    missing_id = F.trim(F.coalesce("chunk_id", F.lit(""))) == ""
    missing_text = F.trim(F.coalesce("text", F.lit(""))) == ""
    checked = F.when(missing_id, F.raise_error(F.lit("Chunk is missing chunk_id"))).when(
        missing_text, F.raise_error(F.concat(F.lit("Chunk is missing text: "), F.col("chunk_id")))
    )
    return chunks.withColumn("chunk_id", F.coalesce(checked.cast("string"), F.col("chunk_id")))


class ChunkStore:
    """Chunk table at `path`. Actions run when a method writes or counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    # --- versions ---
    def _fs(self):
        root = self._file(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> tuple[int, list[dict]]:
        """Number of the current version and its batches (folder, rows, drops), oldest first."""
        fs, folder = self._fs(), self._file(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.path}/_versions/{max(numbers):012d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _switch(self, after: int, batches: list[dict]) -> None:
        """Make `batches` the version that follows `after`; fails if another writer was first."""
        fs, name = self._fs(), f"{self.path}/_versions/{after + 1:012d}.json"
        draft = self._file(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        if fs.exists(self._file(name)) or not fs.rename(draft, self._file(name)):
            fs.delete(draft, False)
            raise RuntimeError(f"the store at {self.path} was changed by another writer")

    # --- reading ---
    def exists(self) -> bool:
        """Is there any stored batch?"""
        return bool(self.version()[1])

    def read(self) -> DataFrame:
        return self._live(self.version()[1])

    def _live(self, batches: list[dict], where: Column | None = None) -> DataFrame:
        """Rows of the batches that no later batch has replaced or dropped."""
        if not batches:
            raise ValueError(f"nothing is stored at {self.path}")

        def stored(n: int) -> DataFrame:
            rows = self.spark.read.parquet(f"{self.path}/{batches[n]['folder']}/rows").withColumn("_batch", F.lit(n))
            return rows if where is None else rows.where(where)

        full = [n for n, b in enumerate(batches) if b["rows"]]
        if not full:
            return stored(0).drop("_batch").limit(0)
        rows = stored(full[0])
        for n in full[1:]:
            rows = rows.unionByName(stored(n), allowMissingColumns=True)
        if full[1:]:
            later = stored(full[1]).select("chunk_id", "_batch")
            for n in full[2:]:
                later = later.unionByName(stored(n).select("chunk_id", "_batch"))
            newest = later.groupBy("chunk_id").agg(F.max("_batch").alias("_newest"))
            rows = rows.join(newest, "chunk_id", "left").where("_newest is null or _newest = _batch").drop("_newest")
        drops = [n for n, b in enumerate(batches) if b["drops"] and n > full[0]]
        if drops:
            gone = None
            for n in drops:
                part = self.spark.read.parquet(f"{self.path}/{batches[n]['folder']}/drops").withColumn("_by", F.lit(n))
                gone = part if gone is None else gone.unionByName(part)
            gone = gone.groupBy("website_id").agg(F.max("_by").alias("_by"))
            rows = rows.join(gone, "website_id", "left").where("_by is null or _by <= _batch").drop("_by")
        return rows.drop("_batch")

    # --- writing ---
    def _write(self, rows: DataFrame, folder: str, metrics: dict[str, Column]) -> dict[str, int]:
        """Write the rows of a batch; returns what was observed on the way."""
        seen = Observation()
        placed = rows.withColumn("bucket", _bucket()).repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(self._writers())))
        placed = placed.sortWithinPartitions("bucket", "website_id", "chunk_id")
        counted = {"rows": F.count(F.lit(1)), **metrics}
        placed = placed.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counted.items()])
        placed.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket").parquet(f"{self.path}/{folder}/rows")
        return {name: int(seen.get[name]) for name in counted}

    def _writers(self) -> int:
        """Tasks that may share a bucket, so that one very large site is not one task."""
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)

    def upsert(
        self, chunks: DataFrame, replace_sites: bool = False, metrics: dict[str, Column] | None = None
    ) -> dict[str, int]:
        """Insert chunks, replacing stored ones with the same id; later rows win inside a batch.

        With `replace_sites` every stored chunk of the incoming sites goes, in the same version.
        Returns `upserted`, `deleted` and the `metrics` (aggregates over the rows written). The rows
        are read once; the counts come from the write itself.
        """
        order = [F.col("chunk_index").desc()] if "chunk_index" in chunks.columns else [F.col("text")]
        w = Window.partitionBy("chunk_id").orderBy(*order)
        incoming = check_chunks(chunks).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        number, batches = self.version()
        folder = f"batch-{number + 1:012d}-{uuid.uuid4().hex}"
        done = self._write(incoming, folder, metrics or {})
        result = {"upserted": done["rows"], "deleted": 0, **{m: done[m] for m in metrics or {}}}
        if not done["rows"]:
            self._delete(folder)
            return result
        drops = bool(batches) and replace_sites
        if drops:
            sites = self.spark.read.parquet(f"{self.path}/{folder}/rows").select("website_id").distinct()
            result["deleted"] = self._drop(sites, folder, batches)
        self._switch(number, batches + [{"folder": folder, "rows": done["rows"], "drops": drops}])
        self._compact_if_due()
        return result

    def _drop(self, sites: DataFrame, folder: str, batches: list[dict]) -> int:
        """Write the sites that a batch drops; returns how many live chunks they had."""
        sites.write.parquet(f"{self.path}/{folder}/drops")
        dropped = self.spark.read.parquet(f"{self.path}/{folder}/drops")
        return self._live(batches).join(dropped, "website_id", "left_semi").count()

    def delete_sites(self, sites: DataFrame) -> int:
        """Drop all chunks of the given website_ids; returns how many there were."""
        number, batches = self.version()
        if not batches:
            return 0
        folder = f"batch-{number + 1:012d}-{uuid.uuid4().hex}"
        deleted = self._drop(sites.select("website_id").where("website_id != ''").distinct(), folder, batches)
        if not deleted:
            self._delete(folder)
            return 0
        self._switch(number, batches + [{"folder": folder, "rows": 0, "drops": True}])
        self._compact_if_due()
        return deleted

    def _compact_if_due(self) -> None:
        _, batches = self.version()
        later = sum(b["rows"] for b in batches[1:])
        if len(batches) > COMPACT_BATCHES or (len(batches) > 1 and later > COMPACT_SHARE * max(1, batches[0]["rows"])):
            self.compact()

    def compact(self) -> None:
        """Write the live rows as one batch. Readers of earlier versions keep their files until `vacuum`."""
        number, batches = self.version()
        folder = f"batch-{number + 1:012d}-{uuid.uuid4().hex}"
        done = self._write(self._live(batches), folder, {})
        self._switch(number, [{"folder": folder, "rows": done["rows"], "drops": False}])

    def vacuum(self) -> None:
        """Delete the batches that the current version does not list: only when nobody reads them."""
        _, batches = self.version()
        listed, fs = {b["folder"] for b in batches}, self._fs()
        for status in fs.listStatus(self._file(self.path)) if batches else []:
            name = status.getPath().getName()
            if name.startswith("batch-") and name not in listed:
                self._delete(name)

    def _delete(self, folder: str) -> None:
        self._fs().delete(self._file(f"{self.path}/{folder}"), True)

    # --- sites ---
    def site(self, website_id: str, filters: dict | None = None) -> DataFrame:
        """Chunks of one site; bucket, site and filters all reach the scan of a single batch."""
        bucket = self.spark.range(1).select(
            F.pmod(F.xxhash64(F.lit(website_id)), F.lit(BUCKETS)).cast("int")
        ).first()[0]
        mine = (F.col("bucket") == bucket) & (F.col("website_id") == website_id)
        return where_filter(self._live(self.version()[1], mine), website_id, filters)

    def site_chunks(
        self, website_id: str, limit: int | None = None, chunk_types: list[str] | None = None
    ) -> DataFrame:
        """Chunks of a site, with `limit` the first ones in storage order."""
        types = [t for t in chunk_types or [] if t]
        rows = self.site(website_id, {"chunk_type": types})
        if limit is None:
            return rows
        order = [c for c in ("chunk_index", "page_ord", "type_ord", "item", "piece") if c in rows.columns]
        return top_per_key(rows, ["website_id"], [F.col(c) for c in [*order, "chunk_id"]], max(1, limit))

    def count_site(self, website_id: str) -> int:
        return self.site(website_id).count() if website_id and self.exists() else 0

    def stats(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("total_chunks"))
