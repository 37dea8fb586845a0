"""Addresses joined with many blocks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.functions.ips import cidr_bounds

#: Blocks up to so many are broadcast.
FEW = 100_000


def blocks_frame(spark, blocks: list[str]) -> DataFrame:
    """(block, family, bits, prefix, lo, hi) of texts."""
    rows = []
    for text in blocks:
        bounds, bits = cidr_bounds(text), int(text.partition("/")[2])
        whole = bits // 8 * 8
        rows.append((text, bounds.family, bits, whole // 8, bytearray(bounds.lo[: whole // 8]), bytearray(bounds.lo), bytearray(bounds.hi)))
    return spark.createDataFrame(rows, "block string, family int, bits int, width int, prefix binary, lo binary, hi binary")


def join_blocks(addresses: DataFrame, blocks: DataFrame, ip: str = "ip") -> DataFrame:
    """Rows of addresses with each block that holds them.

    An equality join on the whole bytes of the prefix, for each width that blocks have (at most 17 of
    either family), and the range test on what meets; no row is compared with every block.
    """
    widths = sorted((r["family"], r["width"]) for r in blocks.select("family", "width").distinct().collect())
    if not widths:
        return addresses.join(blocks.select("block").limit(0), F.lit(True), "inner")
    small = F.broadcast(blocks) if blocks.count() <= FEW else blocks
    size = F.octet_length(F.col(ip))
    want = lambda fam: F.array(*(F.lit(w) for f, w in widths if f == fam)).cast("array<int>")
    asked = addresses.withColumn("_width", F.explode(F.when(size == 4, want(4)).when(size == 16, want(6)).otherwise(F.array().cast("array<int>"))))
    asked = asked.withColumn("_prefix", F.substr(F.col(ip), F.lit(1), F.col("_width")))
    met = asked.join(
        small.select(F.col("block"), F.col("width").alias("_w"), F.col("prefix").alias("_p"), F.col("family").alias("_f"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")),
        (F.col("_width") == F.col("_w")) & (F.col("_prefix") == F.col("_p")) & (F.octet_length(F.col(ip)) == F.when(F.col("_f") == 4, 4).otherwise(16)),
    )
    return met.where(F.col(ip).between(F.col("_lo"), F.col("_hi"))).select(*addresses.columns, "block")
