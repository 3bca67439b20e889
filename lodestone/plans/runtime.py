"""Session services shared by every operator: worker environment, shared storage, cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of one Arrow batch: documents are a few KB each, so a batch stays a few MB.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of documents small.

    Sets the session's Arrow batch limits for as long as it lives, as plans read them when they run.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    # workers are kept between stages: what a task frees goes back to the system
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(24 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(32 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only (the path may be one that only Spark can open)."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local session may do without: it gets a
    temporary folder; elsewhere a local folder would be another one on every machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


#: For each thread, the tables written since each of its open scratch() began, innermost last.
_OPEN = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES: dict[str, list] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Plans that run inside lose their shuffle files when they end; for plans that run once, as those of writes do.

    Threads may overlap: the first one in sets the session's setting, the last one out restores it.
    """
    key = spark._jsparkSession.sessionUUID()
    with _LOCK:
        held = _WRITES.setdefault(key, [0, spark.conf.get(_CLEANUP, "false")])
        held[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_CLEANUP, _WRITES.pop(key)[1])


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it again.

    The table survives the loss of any executor. The write's shuffle files go when it ends. release(), the end of a scratch() it was written in, or
    release_all() deletes it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_end(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    for scope in _scopes()[-1:]:
        scope.append(out)
    return out


@contextlib.contextmanager
def scratch():
    """Delete the tables written inside when the block ends, but for those taken out by keep(df)."""
    own: list[DataFrame] = []
    _scopes().append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        return df

    try:
        yield keep
    finally:
        _scopes().pop()
        release(*own)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now; it does when their objects are collected on the driver."""
    spark._jvm.System.gc()


def stands(df: DataFrame) -> bool:
    """Whether a table made by materialize() has not been deleted."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df._lodestone_path}/_SUCCESS")
    return at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_lodestone_path", None):
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table this application has materialised; results that read them must have been used."""
    _delete(spark, f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the input has fewer partitions, as a small file of one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
