"""Statistics of the files that a search found."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ipquarry.functions.filenames import bucket, bucket_pattern, time_column

NO_TIME = "0001-01-01T00:00:00Z"


def timed(hits: DataFrame, regex: str | None) -> DataFrame:
    """(filename, doc_time): the time of each name, null where it has none."""
    at = time_column("filename", regex) if regex else F.lit(None).cast("timestamp")
    return hits.select("filename", at.alias("doc_time"))


#: Characters beyond what all names share that a part of the order is cut by; a date's length.
CUT = 10


#: Up to so many hits are put in order by one task.
FEW = 100_000
#: Errors of a report, at most; how many there are beyond that is said in one more.
MOST_ERRORS = 10_000


def histogram(files: DataFrame, groupby: str, count: str) -> DataFrame:
    """(island, bucket, hits): runs of equal labels in name order, and how often the finer label changes in each.

    It follows the files, not the labels: a label that comes back later begins another run. Beyond FEW hits the
    order is worked through part by part, each with the last labels of the one before and the runs that began
    earlier, so no task sorts all files; only the parts themselves, one row each, are put in one order.
    """
    known = files.where("doc_time is not null").select("filename", bucket("doc_time", groupby).alias("bucket"), bucket("doc_time", count).alias("label"))
    ends = known.agg(F.count("*").alias("n"), F.min("filename").alias("a"), F.max("filename").alias("b")).first()
    if ends["n"] <= FEW:
        every = Window.orderBy("filename")
        prior = F.lag(F.struct("bucket", "label")).over(every)
        rows = known.withColumn("prior", prior).withColumn("open", F.when(F.col("prior").isNull() | (F.col("prior.bucket") != F.col("bucket")), 1).otherwise(0))
        hit = F.when((F.col("open") == 1) | (F.col("prior.label") != F.col("label")), 1).otherwise(0)
        rows = rows.select("bucket", hit.alias("hit"), F.sum("open").over(every.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
        return rows.groupBy("island", "bucket").agg(F.sum("hit").alias("hits"))
    # ordering by (part, filename) is ordering by filename
    shared = len(os.path.commonprefix([ends["a"], ends["b"]]))
    known = known.withColumn("part", F.substring("filename", 1, shared + CUT))
    order, parts = Window.partitionBy("part").orderBy("filename"), Window.orderBy("part")
    last = known.groupBy("part").agg(F.max_by(F.struct("bucket", "label"), "filename").alias("last"))
    before = last.select("part", F.lag("last").over(parts).alias("before"))
    rows = known.join(before, "part").withColumn("prior", F.coalesce(F.lag(F.struct("bucket", "label")).over(order), "before"))
    opens = F.when(F.col("prior").isNull() | (F.col("prior.bucket") != F.col("bucket")), 1).otherwise(0)
    hit = F.when((F.col("open") == 1) | (F.col("prior.label") != F.col("label")), 1).otherwise(0)
    rows = rows.withColumn("open", opens).select("part", "filename", "bucket", "open", hit.alias("hit"))
    began = rows.groupBy("part").agg(F.sum("open").alias("n"))
    began = began.select("part", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    marked = rows.join(began, "part").withColumn("island", F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("earlier"))
    return marked.groupBy("island", "bucket").agg(F.sum("hit").alias("hits"))


def summary(files: DataFrame) -> DataFrame:
    """One row: hits, first and last name, and the times of those two names."""
    return files.agg(
        F.count("*").alias("hits"), F.min("filename").alias("first"), F.max("filename").alias("last"),
        F.min_by("doc_time", "filename").alias("first_time"), F.max_by("doc_time", "filename").alias("last_time"),
    )


def errors(files: DataFrame) -> DataFrame:
    """(filename, error) of names without a time."""
    said = F.concat(F.lit('filename_to_time_regex did not match "'), "filename", F.lit('"'))
    return files.where("doc_time is null").select("filename", said.alias("error"))


def report(hits: DataFrame, regex: str | None, groupby: str, count: str) -> dict:
    """All of it, for JSON. A unit that isn't one raises ValueError, if any file has a time."""
    files = timed(hits, regex).cache()
    try:
        # formatted by Spark, so that the driver's zone plays no part
        text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
        top = summary(files).select("hits", "first", "last", text("first_time"), text("last_time")).first()
        buckets = []
        if not files.where("doc_time is not null").isEmpty():
            for unit in (groupby, count):
                bucket_pattern(unit)
            buckets = [{"bucket": r["bucket"], "hits": r["hits"]} for r in histogram(files, groupby, count).orderBy("island").collect()]
        wrong = [r["error"] for r in errors(files).orderBy("filename").limit(MOST_ERRORS).collect()]
        if len(wrong) == MOST_ERRORS and (more := errors(files).count() - MOST_ERRORS):
            wrong.append(f"{more} more files without a time")
    finally:
        files.unpersist()
    return {
        "hits": top["hits"], "first": top["first"] or "", "last": top["last"] or "", "first_time": top["first_time"] or NO_TIME,
        "last_time": top["last_time"] or NO_TIME, "buckets": buckets or None, "errors": wrong or None,
    }
