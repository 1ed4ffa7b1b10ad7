"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "sitelore", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect. Cluster settings win when given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture makes building large column expressions twice as slow
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # page rows carry whole HTML documents: keep Arrow batches small in rows
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for cut lineage: `spark.checkpoint.dir`, shared by all executors.

    Only a local master may fall back to a temporary folder, because there the
    driver and the executors are one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="sitelore-checkpoint-")
        root = _LOCAL_ROOTS[app]
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts lineage so that losing an executor re-reads files instead of repeating
    the upstream work, and lets several consumers share one computation with
    column pruning intact.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_alone(df: DataFrame, name: str) -> DataFrame:
    """`materialize`, and the exchange files of the write go as soon as it ends: what is read from then on is
    the table. Without this they stay until the driver's garbage collector finds them."""
    conf = df.sparkSession.conf
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, None)
    conf.set(setting, "true")
    try:
        return materialize(df, name)
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; inside `scratch` it is deleted at the end."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


TEXTS_PER_BATCH = 1000
BYTES_PER_BATCH = 4 << 20


def whole_texts(df: DataFrame) -> DataFrame:
    """`df`, with short Arrow batches in its session, in rows and in bytes: whole texts and pages
    go to Python, and a batch takes its memory several times over (buffers of both sides, Python's
    strings, results). The defaults are 10,000 rows and 64 MB; smaller settings are left alone."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXTS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        name = f"spark.sql.execution.arrow.{name}"
        now = str(conf.get(name)).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that `materialize` writes (or `scratch_path` names) inside: for jobs that end with
    a write of their own. What a caller still reads later must be written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
