"""Forms of posting lists: differences and bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta_encode(column: Column | str) -> Column:
    """First differences of array<long>, from 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.zip_with(c, F.slice(F.concat(F.array(F.lit(0).cast("long")), c), F.lit(1), F.size(c)), lambda x, before: x - before)


def delta_decode(column: Column | str) -> Column:
    """Running sums of array<long>: the inverse of delta_encode."""
    c = F.col(column) if isinstance(column, str) else column
    start = F.array().cast("array<long>")
    return F.aggregate(c, start, lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x)))


def delta_encode_rows(postings: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, delta): differences as rows, for lists of any length."""
    from pyspark.sql import Window

    before = F.lag(value, 1, 0).over(Window.partitionBy(key).orderBy(value))
    return postings.select(key, value, (F.col(value) - before).alias("delta"))


def bitmaps(postings: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bucket, bitmap): sets of numbers as bitmaps, one row per bucket of 32768."""
    return postings.groupBy(key, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bitmap"))


def bitmap_union(maps: DataFrame, key: str) -> DataFrame:
    """(key, n): distinct members of all bitmaps of a key."""
    return maps.groupBy(key, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).groupBy(key).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def msgpack_encode(column: Column | str) -> Column:
    """array<long> of numbers that aren't negative as a MessagePack array; each number in the shortest form."""
    c = F.col(column) if isinstance(column, str) else column
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")

    def number(x: Column) -> Column:
        forms = [(1 << 7, "", 2), (1 << 8, "CC", 2), (1 << 16, "CD", 4), (1 << 32, "CE", 8)]
        out = F.when(x < forms[0][0], digits(x, 2))
        for most, mark, n in forms[1:]:
            out = out.when(x < most, F.concat(F.lit(mark), digits(x, n)))
        return out.otherwise(F.concat(F.lit("CF"), digits(x, 16)))

    n = F.size(c).cast("long")
    head = F.when(n < 16, digits(n + 0x90, 2)).when(n < 1 << 16, F.concat(F.lit("DC"), digits(n, 4))).otherwise(F.concat(F.lit("DD"), digits(n, 8)))
    return F.unhex(F.concat(head, F.array_join(F.transform(c, number), "")))
