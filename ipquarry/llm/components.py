"""Connected components of a table of links, by forests of tasks and alternating large-star and small-star steps.

A task that gets LINKS of the links at most joins them by itself and leaves a star for each of its components:
chains become short whatever their length, and a table that fits a task is done. What the stars of different
tasks have in common is joined by steps that are a minimum per vertex, with partial aggregation, and a join that
adaptive execution may split at hot vertices. Every round's links are written to the shared folder, so lineage
stays short, and no task or driver ever holds more than LINKS links. It ends when a round leaves the links as they
were; they are stars then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import drop, held, stored

#: Links that a task joins at once, about.
LINKS = 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for all other vertices of links a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while ((up := parent[parent]) != parent).any():
            parent = up
    other = np.nonzero(parent != np.arange(len(nodes)))[0]
    return nodes[other], nodes[parent[other]]


def _forests(batches):
    held_ = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if held_:
        a, b = forest(*(np.concatenate(x) for x in zip(*held_, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _print(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every vertex of links (a, b); root is the smallest vertex of its component."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")), "links")
    seen = _print(now)
    spark = links.sparkSession
    while seen[0]:
        tasks = -(-seen[0] // LINKS)
        stars = now.repartition(tasks).mapInArrow(_forests, "a long, b long")
        if tasks == 1:
            now, done = stored(stars, "links"), now
            drop(spark, done)
            break
        stars = held(stars)
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # what has no larger neighbour still has to point to its least one
        large = large.union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        down = held(large)
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = down.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = stored(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        drop(spark, now)
        for used in (down, stars):
            used.unpersist()
        now, before = new, seen
        seen = _print(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
