"""Helpers shared by the operators: table access and tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []


#: Rows and bytes of an Arrow batch, at most; one longer row is a batch of its own. A worker holds a batch and
#: what it makes of it, so long texts have to be bounded by their bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Fixed by Spark: its own bound of a batch's bytes, as its setting is written.
DEFAULT_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, where the session has Spark's defaults.

    Batches are cut when a plan runs, by the session's settings of that time, so they can't be put back here.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", DEFAULT_BYTES, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(value))


#: Fixed by Spark: the setting by which an action removes the files that it has shuffled.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table to work through in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, a null text as the empty one; other columns don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are this machine, gets one of our own where that is unset.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir isn't set; on a cluster it has to name a folder that all executors share")
    if not _OWN or not any(s is spark for s, _ in _OWN):
        _OWN.append((spark, "file://" + tempfile.mkdtemp(prefix="ipquarry-")))
    return next(d for s, d in _OWN if s is spark)


#: What has been written and kept inside of scopes, innermost last.
_SCOPES: list[list] = []


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables that are stored or held inside go at its end, but for those that the yielded function was given."""
    own: list = []
    _SCOPES.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.ipquarry_path)
        return df

    try:
        yield keep
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not own]
        for what in own:
            if isinstance(what, str):
                drop(spark, what)
            else:
                what.unpersist()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one, removed at the end of the scope it's made in, or of the driver."""
    path = f"{shared_dir(spark)}/ipquarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    atexit.register(drop, spark, path)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    What was shuffled to make it isn't needed any more and goes at once, not with the driver's next collection.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.ipquarry_path = path
    return out


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors, for small tables that are read more than once outside of loops.

    Its lineage stays, so blocks of a lost executor are made again; nothing is written to the shared folder.
    """
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def drop(spark: SparkSession, what: DataFrame | str) -> None:
    """Removes a stored table that nothing reads any more."""
    path = what if isinstance(what, str) else what.ipquarry_path
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; the folder belongs to the cluster's temporary data
        pass


@functools.cache
def _malloc():
    try:
        pa.set_memory_pool(pa.system_memory_pool())
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def trim() -> None:
    """Memory that arrays have given up goes back to the system, on a worker or the driver.

    Spark keeps workers between stages, so what one holds on to adds to what others need.
    """
    _malloc()(0)


#: Rows of keys that may be broadcast, some tens of MB.
FEW = 250_000


def few(keys: DataFrame) -> DataFrame:
    """keys with a hint to broadcast them where their counted number is at most FEW; joined by shuffle otherwise."""
    return F.broadcast(keys) if keys.count() <= FEW else keys
