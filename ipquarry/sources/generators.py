"""Synthetic logs for tests and benchmarks, made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice"


def random_ipv4(seed: int, octets: int = 4, prefix: str = "10.20.30.40") -> Column:
    """Dotted addresses whose last octets are random and whose first ones are those of prefix."""
    fixed = prefix.split(".")[: 4 - octets]
    return F.concat_ws(".", *(F.lit(x) for x in fixed), *(F.floor(F.rand(seed + i) * 256).cast("string") for i in range(octets)))


def tsv_lines(spark: SparkSession, n: int, seed: int = 0, octets: int = 4) -> DataFrame:
    """(value): n connection records in tab-separated form; HEADER goes first in a file."""
    return spark.range(n).select(F.concat_ws("\t", (F.col("id") + 1426000000).cast("string"), F.concat(F.lit("C"), F.hex("id")), random_ipv4(seed, octets), F.lit("1234"), random_ipv4(seed + 10, octets), F.lit("80"), F.lit("tcp"), F.lit("http")).alias("value"))


def json_lines(spark: SparkSession, n: int, seed: int = 0, octets: int = 4) -> DataFrame:
    """(value): n connection records as JSON."""
    fields = {"ts": F.col("id") + 1426000000, "uid": F.concat(F.lit("C"), F.hex("id")), "id.orig_h": random_ipv4(seed, octets), "id.orig_p": F.lit(1234), "id.resp_h": random_ipv4(seed + 10, octets), "id.resp_p": F.lit(80), "proto": F.lit("tcp")}
    return spark.range(n).select(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))
