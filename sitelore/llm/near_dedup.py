"""Near-duplicate documents: five-word shingles, DartMinHash signatures, banded joins.

1. One pass over the texts makes each document's shingle hashes and signature.
2. Equal word sequences become one class; one document stands for it from here on.
3. Documents that agree in a whole band of the signature share a bucket. Each member is
   compared exactly with the bucket's first document, so a bucket of n makes n - 1 pairs.
4. In buckets that still hold several components, every member outside the first document's
   component is compared exactly with all others inside tasks, in blocks of bounded size.
   A pair is looked at in the first band it shares only, and not at all once its components
   have met, so what leaves a task is a link per component, never the pairs.
5. The links' connected components are the classes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.components import connected_components
from sitelore.llm.darts import mix, signature
from sitelore.llm.files import parallelism, whole_texts
from sitelore.llm.runs import runs, small_batches
from sitelore.session import materialize, scratch_path

WORDS = 5
BANDS, ROWS = 32, 4
SALTED = 256  # members compared with one document in one run
BLOCK = 2048  # members outside the first document's component in one block
COLUMNS = 4096  # members that they are compared with in one block
BLOCK_BYTES = COLUMN_BYTES = 48 << 20  # of shingles, bounds beside those in members; also of a run
INDEX_BYTES = 8 << 20  # of shingles that are in order at a time while a block is compared

WORD = re.compile(r"\w+")
_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, dtype="uint64"))


def words_of(text: str | None) -> list[str]:
    """Lower-case words; of a text without any, its parts between white space."""
    text = (text or "").lower()
    return WORD.findall(text) or text.split()


def _word_hashes(data: bytes) -> np.ndarray:
    """One hash per word of words joined and ended by a space."""
    raw = np.frombuffer(data, "u1")
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return mix(np.add.reduceat((raw.astype("uint64") + np.uint64(1)) * _POWERS[place % len(_POWERS)], starts))


def shingles(data: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts. A text of fewer words is one shingle."""
    hashed = _word_hashes(data)
    size = min(words, len(hashed))
    count = len(hashed) - size + 1
    total = np.zeros(count, dtype="uint64")
    for j in range(size):
        total = mix(total + hashed[j : j + count] + np.uint64(j + 1))
    return np.unique(total, return_counts=True)


def band_keys(names: np.ndarray) -> np.ndarray:
    """Bucket names, one per band, of signatures in rows. A name ends in the band's number."""
    bands = names.astype("uint64").reshape(len(names), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype="uint64"), (len(names), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + bands[:, :, r] + np.uint64(1))
    return ((key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype="uint64")).view("int64")


def sign_documents(docs: DataFrame, weighted: bool) -> DataFrame:
    """uid, doc_id, text_hash, key, bands, signature, shingles per row; the last four null
    without words."""
    k = BANDS * ROWS

    def sign(batches):
        for part in small_batches(batches, 512):
            cols: list[list] = [[] for _ in range(4)]
            for text in part.column(3).to_pylist():
                words = words_of(text)
                if not words:
                    for col in cols:
                        col.append(None)
                    continue
                data = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
                elements, counts = shingles(data)
                names = signature(elements, counts if weighted else None, k)
                # 32 bits a shingle are enough for one pair; the wide hash made the signature
                small = np.unique(elements.astype("uint32"))
                cols[0].append(xxhash.xxh3_128_digest(data))
                cols[1].append(band_keys(names[None, :])[0].tolist())
                cols[2].append(names.tobytes())
                cols[3].append(small.tobytes())
            types = (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types))],
                ["uid", "doc_id", "text_hash", "key", "bands", "signature", "shingles"],
            )

    rows = whole_texts(docs).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        sign, "uid long, doc_id long, text_hash long, key binary, bands array<long>, signature binary, shingles binary"
    )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _parts(rows: int, size: int):
    """Aggregate: parts that hold about `rows` rows and `size` bytes each."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("size") / size), F.lit(1)).cast("int")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """bucket, band, uid, a, size of the buckets of two documents or more; `a` is the first.

    `reps`: uid, size, bands. Names and ids travel once, for both sides of the join; what is
    the same for all rows of a document is added to the few rows that are left.
    """
    named = reps.select("uid", F.explode("bands").alias("bucket")).repartition(
        parallelism(reps.sparkSession), "bucket"
    )
    leaders = named.groupBy("bucket").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(named.join(leaders, "bucket").select("bucket", "uid", "a"), "shared")
    band = F.col("bucket").bitwiseAND(F.lit(BANDS - 1)).cast("int").alias("band")
    return shared.join(reps.select("uid", "size"), "uid").select("bucket", band, "uid", "a", "size")


@contextmanager
def dealt_by_uid(sets: DataFrame) -> Iterator[DataFrame]:
    """`sets` as a table in buckets of uid, so that a join by uid moves its other side only.
    Its name is valid inside the block; its files lie in the shared folder."""
    spark, count = sets.sparkSession, parallelism(sets.sparkSession)
    name = f"spark_catalog.default.near_dedup_sets_{uuid.uuid4().hex}"
    dealt = sets.repartition(count, "uid").write.bucketBy(count, "uid")
    dealt.option("path", scratch_path(spark, "sets")).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose exact Jaccard similarity reaches `threshold`.

    `pairs` has `size`, the bytes of b's shingles; `sets`: uid, shingles. The pairs of one `a`
    are cut into runs of about `SALTED` and `COLUMN_BYTES`, each with its own copy of a's set,
    so a document with any number of partners spreads out.
    """
    counts = pairs.groupBy("a").agg(_parts(SALTED, COLUMN_BYTES).alias("salts"))
    members = pairs.join(counts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b"
    )
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
    # written, so that Spark knows its size: while it is small, the sets stay where they are
    wanted = materialize(members.withColumn("kind", F.lit(1)).unionByName(heads.withColumn("kind", F.lit(0))), "wanted")
    loaded = wanted.join(sets.withColumnRenamed("uid", "b"), "b")
    key = ["a", "salt"]
    met = loaded.repartition(parallelism(pairs.sparkSession), *key).sortWithinPartitions(*key, "kind")

    def compare(batches):
        for (a, _), found in runs(batches, key):
            sets_ = [np.frombuffer(s, "uint32") for s in found["shingles"].to_pylist()]
            partners = found["b"].to_pylist()
            kept = [
                b for b, s in zip(partners[1:], sets_[1:])
                if min(len(s), len(sets_[0])) >= threshold * max(len(s), len(sets_[0]))
                and _jaccard(sets_[0], s) >= threshold
            ]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([a] * len(kept), pa.int64()), "b": pa.array(kept, pa.int64())}
            )

    return met.select("a", "salt", "kind", "b", "shingles").mapInArrow(compare, "a long, b long")


def _unresolved(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, band, a, uid, part, minor, blocks, columns of the buckets of three or more that
    hold several components; of buckets with the same members the one of the lowest band.
    `minor`: outside the component of the bucket's first document `a`."""
    part = F.coalesce("component", "uid").alias("part")
    named = buckets.join(groups, F.col("uid") == F.col("id"), "left").select("bucket", "band", "uid", "a", "size", part)
    state = named.groupBy("bucket", "band").agg(
        F.count(F.lit(1)).alias("n"), _parts(COLUMNS, COLUMN_BYTES).alias("columns"),
        F.min("part").alias("low"), F.max("part").alias("high"),
        F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("members"),
        F.max(F.when(F.col("uid") == F.col("a"), F.col("part"))).alias("major"),
    )
    some = (
        state.where("low <> high and n > 2").groupBy("n", "columns", "members", "major")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select(F.col("b.bucket").alias("bucket"), "columns", "major")
    )
    # written: it is read four times below, and few rows are left
    rows = materialize(named.join(some, "bucket").withColumn("minor", F.col("part") != F.col("major")), "unresolved")
    sizes = rows.where("minor").groupBy("bucket").agg(_parts(BLOCK, BLOCK_BYTES).alias("blocks"))
    return rows.join(sizes, "bucket").select(
        "bucket", "band", "a", "uid", "part", "minor", "blocks", "columns"
    )


def bucket_links(buckets: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between components of `groups` that buckets (bucket, band, uid, a, size) hold.

    `sets`: uid, shingles, and the signature or its bands. A block meets up to about `BLOCK` minor members with
    `COLUMNS` others, fewer of long texts (`BLOCK_BYTES`, `COLUMN_BYTES`); its links join each pair of components that it can join once.
    """
    open_ = _unresolved(buckets, groups)
    block = F.pmod(F.xxhash64("uid", F.lit(2)), F.col("blocks")).cast("int")
    column = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("columns")).cast("int")
    fields = ["bucket", "block", "column", "band", "a", "uid", "part", "asks"]
    # a minor member of a single column and block comes once, on both sides
    asking = open_.where("minor and (columns > 1 or blocks > 1)").withColumn("block", block).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    ).withColumn("asks", F.lit(1))
    both = F.when(F.col("minor") & (F.col("columns") == 1) & (F.col("blocks") == 1), F.lit(2)).otherwise(F.lit(0))
    asked = open_.withColumn("column", column).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumn("asks", both)
    dealt = materialize(asking.select(*fields).unionByName(asked.select(*fields)), "dealt").join(sets, "uid")
    if "bands" in sets.columns:  # of which only those before the bucket's are looked at
        names = F.slice("bands", F.lit(1), F.col("band")).alias("bands")
    else:
        names = F.col("signature")
    key = ["bucket", "block", "column"]
    met = dealt.select(*fields, names, "shingles").repartition(
        parallelism(buckets.sparkSession), *key
    ).sortWithinPartitions(*key)

    def link(batches):
        for _, found in runs(batches, key):
            links = _links_of_block(found, threshold)
            if links:
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
                )

    return met.mapInArrow(link, "a long, b long")


def _links_of_block(found: pa.Table, threshold: float) -> list[tuple[int, int]]:
    uid, part, asks = (found[c].to_numpy() for c in ("uid", "part", "asks"))
    first, band = found["a"][0].as_py(), found["band"][0].as_py()
    if "bands" in found.column_names:
        flat = found["bands"].combine_chunks().flatten()
        earlier = flat.to_numpy(zero_copy_only=False).reshape(len(uid), band)
    else:
        names = np.stack([np.frombuffer(s, "uint32") for s in found["signature"].to_pylist()])
        earlier = band_keys(names)[:, :band]
    sets = [np.frombuffer(s, "uint32") for s in found["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    above: dict[int, int] = {}

    def root(p: int) -> int:
        while p in above:
            p = above[p]
        return p

    others = np.flatnonzero(asks != 1)
    others = others[uid[others] != first]  # its pairs are known
    links = []
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[others]) * 4 // INDEX_BYTES)) + 1
    for chunk in np.split(others, cuts) if len(others) else []:
        # all shingles of these rows in order, with the rows that hold them
        held = np.concatenate([sets[j] for j in chunk])
        order = np.argsort(held, kind="stable")
        held, holders = held[order], np.repeat(chunk.astype("int32"), sizes[chunk])[order]
        for i in np.flatnonzero(asks):
            # the larger set bounds the similarity
            rows = chunk[
                (part[chunk] != part[i])
                & (np.minimum(sizes[chunk], sizes[i]) >= threshold * np.maximum(sizes[chunk], sizes[i]))
            ]
            rows = rows[~(earlier[rows] == earlier[i]).any(axis=1)]
            if not len(rows):
                continue
            starts = np.searchsorted(held, sets[i], "left")
            counts = np.searchsorted(held, sets[i], "right") - starts
            at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(holders[at], minlength=len(sets))[rows]
            for j in rows[both / (sizes[rows] + sizes[i] - both) >= threshold]:
                p, q = root(int(part[i])), root(int(part[j]))
                if p != q:
                    above[max(p, q)] = min(p, q)
                    links.append((int(uid[i]), int(uid[j])))
    return links


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """doc_id, text_hash, class_id, kept, wordless per row of `docs` (`doc_id`, `text`).

    Documents whose sets of five-word shingles have a Jaccard similarity of `threshold` or
    more are linked; classes are the components of the links, named by their smallest
    doc_id, and one row of each has `kept`. With `weighted`, shingles count as often as they
    occur when candidates are found; links are always confirmed on the sets.

    Equal word sequences are one class whatever their case and punctuation. Texts without
    words (null, empty, white space) are alike to nothing: each row is a class of its own.
    Texts of any length are compared whole; blocks are bounded by their bytes. Null doc_ids take part and name a class only when it has no other; repeated rows are
    copies of each other. Other columns are not read. An empty table gives no rows.
    """
    signed = sign_documents(docs, weighted).withColumn("size", F.octet_length("shingles"))
    rows = materialize(signed.drop("signature"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
    reps = materialize(
        # rows of one key have the same words, so the same size and bands
        rows.where("key is not null").groupBy("key").agg(
            first.alias("f"), F.first("size").alias("size"), F.first("bands").alias("bands")
        ).select("key", F.col("f.doc_id").alias("least_id"), F.col("f.uid").alias("uid"), "size", "bands"),
        "representatives",
    )
    buckets = materialize(shared_buckets(reps), "buckets")
    busy = materialize(buckets.select("uid").distinct(), "busy")  # narrow; its size decides how the texts' sets are found
    pairs = buckets.where("uid <> a").select("a", F.col("uid").alias("b"), "size").distinct()
    with dealt_by_uid(rows.join(busy, "uid", "left_semi").select("uid", "shingles", "bands")) as sets:
        links = materialize(verify(pairs, sets.select("uid", "shingles"), threshold), "links")
        more = materialize(bucket_links(buckets, connected_components(links), sets, threshold), "links")
    groups = connected_components(links.unionByName(more))

    named = reps.join(groups, F.col("uid") == F.col("id"), "left").select(
        "key", "least_id", "uid", F.coalesce("component", "uid").alias("component")
    )
    names = named.groupBy("component").agg(
        F.min(F.struct(F.col("least_id").isNull(), "least_id", "uid")).alias("f")
    ).select("component", F.col("f.least_id").alias("class_id"), F.col("f.uid").alias("kept_uid"))
    classes = named.select("key", "component").join(names, "component").select("key", "class_id", "kept_uid")
    return rows.select("doc_id", "text_hash", "uid", "key").join(classes, "key", "left").select(
        "doc_id", "text_hash",
        F.when(F.col("kept_uid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("uid") == F.col("kept_uid"), F.lit(True)).alias("kept"),
        F.col("key").isNull().alias("wordless"),
    )


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of `docs`, all columns, one of each class: a row with the smallest doc_id.

    Of rows that agree in doc_id and text one stays, whatever their other columns; texts
    without words all stay.
    """
    classes = near_duplicate_classes(docs, threshold)
    marks = classes.groupBy("doc_id", "text_hash").agg(
        F.max("kept").alias("_kept"), F.max("wordless").alias("_wordless")
    ).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.col("text_hash").alias("_hash"), "_kept", "_wordless",
    )
    marks = materialize(marks, "marks")  # read twice below
    # a row travels as one struct, whatever its columns are called
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.struct("*").alias("_row"),
    )
    kept = rows.join(marks, ["_id", "_hash"]).where("_kept")
    once = kept.where("not _wordless").dropDuplicates(["_id", "_hash"])  # combined before the shuffle
    return once.unionByName(kept.where("_wordless")).select("_row.*")
