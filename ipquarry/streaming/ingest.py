"""Continuous indexing: a file stream per indexer whose batches index the files that are new.

The stream lists files only; a batch hands their paths to the store, which skips those it knows. So a
batch that runs again after a failure indexes what the failed one didn't commit, and nothing twice.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("ipquarry")

#: Seconds that a file must have been left alone before it's indexed.
SETTLED = 2.0
#: Fixed by Spark's source of whole files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def settled(paths: list[str], age: float = SETTLED, now: float | None = None) -> list[str]:
    """Paths whose files haven't changed for a while; those still growing wait for the next pass."""
    at = time.time() if now is None else now

    def is_settled(path: str) -> bool:
        try:
            return at - os.stat(path.removeprefix("file://")).st_mtime >= age
        except OSError:  # it has gone since
            return False

    return [p for p in paths if is_settled(p)]


def is_growing(path: str, times: int = 10, wait: float = 0.2) -> bool:
    """Whether a file's size changes while it's watched."""
    size = os.stat(path).st_size
    for _ in range(times):
        time.sleep(wait)
        if os.stat(path).st_size != size:
            return True
    return False


def poll(index: Callable[[list[str]], object], listing: Callable[[], list[str]], passes: int | None = None, wait: float = 60.0, stop: Callable[[], bool] = lambda: False) -> None:
    """Indexes what a listing shows, again and again; for listings that a directory stream can't express.

    A pass that raises is logged, and the next one comes all the same.
    """
    while passes is None or passes > 0:
        try:
            index(settled(listing()))
        except Exception as error:
            log.exception("indexing failed: %s", error)
        passes = None if passes is None else passes - 1
        if passes == 0 or stop():
            return
        time.sleep(wait)


def stream(spark: SparkSession, directory: str, name_filter: str, index: Callable[[list[str]], object], checkpoint: str, seconds: int | None = 60):
    """Starts a stream over a directory; seconds None takes what is there and ends.

    name_filter is a glob on file names. The content isn't read by the stream, only each file's path.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", name_filter).option("recursiveFileLookup", "true").load(directory)

    def batch(rows: DataFrame, _: int) -> None:
        # one row for each new file
        names = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/").alias("path")
        paths = sorted({r["path"] for r in rows.select(names).collect()})
        try:
            index(paths)
        except Exception as error:
            # a stream that ends for good would leave later files out as well; the batch is tried once more
            log.exception("indexing failed, trying again: %s", error)
            index(paths)

    writer = files.select("path").writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
