"""Exact top-k search by tiled integer matrix products.

Every component x becomes floor(1024 * x). Queries are taken in blocks whose size in bytes is bounded
(QUERY_BYTES); one block is broadcast at a time, and its lists are stored. Every task multiplies a block
with the tiles of its shard of vectors, selects partially in each tile and merges into one running top list
per query. The lists of the tasks are merged in a tree: FAN_IN lists at a time, grouped by query, until one
is left.

Products are exact: float64 while every sum stays below 2 ** 53, Python integers beyond that.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do
rows with a null id or vectors of another length than the query's; of rows that repeat a query's id the
one with the least vector asks; a query isn't its own candidate, nor are other rows that repeat its id;
repeated rows are candidates each and may repeat in the list; equal scores go to the smaller id. No vectors,
or no queries, give no rows. Scores beyond a long count as the nearest long.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import new_folder, table

SCALE = 1024
#: Most bytes of a broadcast block of queries.
QUERY_BYTES = 16 << 20
TILE = 2048
#: Queries multiplied with a tile at once.
STRIPE = 1024
FAN_IN = 16
_LONG = (1 << 63) - 1
LISTS = "chunk long, part long, queries binary, scores binary, ids binary"


def _vectors(batch):
    """{length: (ids sorted, matrix)} of the rows that take part, with scaled components."""
    ids, column = batch.column("vec_id"), batch.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64())
    flat = np.floor(SCALE * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    use = (wrong[start[1:]] == wrong[start[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    size = np.diff(start)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size[use]).tolist():
        rows = np.nonzero(use & (size == n))[0]
        rows = rows[np.argsort(own[rows], kind="stable")]
        yield n, own[rows], flat[start[rows][:, None] + np.arange(n)]


def product(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products; those beyond a long become the nearest one, before anything is ranked."""
    n = queries.shape[1]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(n, 1)
    if most < 2.0**53:
        return (queries @ tile.T).astype(np.int64)
    exact = [[int(v) for v in row] for row in queries], [[int(v) for v in row] for row in tile]
    out = np.empty((len(queries), len(tile)), np.int64)
    for a, q in enumerate(exact[0]):
        for b, t in enumerate(exact[1]):
            out[a, b] = max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(q, t, strict=True))))
    return out


class Lists:
    """Top lists of a set of queries, best first."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.rows = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def merge(self, rows, scores, ids) -> None:
        """rows: places in queries."""
        rows, scores, ids = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, rows, "left") if len(rows) else rows
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of at least the k best of each row, ties to earlier columns included."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), max(scores.shape[1], 1))
    width = scores.shape[1]
    if max(int(scores.max()), -int(scores.min())) < (1 << 62) // width:
        ranked = scores * width + np.arange(width - 1, -1, -1)
        at = np.argpartition(ranked, width - k, axis=1)[:, width - k :]
        return np.repeat(np.arange(len(scores)), k), at.ravel()
    cut = np.partition(scores, width - k, axis=1)[:, width - k]
    return np.nonzero(scores >= cut[:, None])


def _search(block: bytes, k: int):
    """For mapInArrow: the top lists of a block of queries against a task's vectors."""
    import pickle

    def run(batches):
        from pyspark import TaskContext

        ids, matrix = pickle.loads(block.value)
        lists, part = Lists(ids, k), TaskContext.get().partitionId()
        for batch in batches:
            for n, own, vectors in _vectors(batch):
                if n != matrix.shape[1]:
                    continue
                for at in range(0, len(own), TILE):
                    tile, tile_ids = vectors[at : at + TILE], own[at : at + TILE]
                    for q in range(0, len(ids), STRIPE):
                        scores = product(matrix[q : q + STRIPE], tile)
                        # a query's own row may take one place of its list, so one more is selected
                        same = np.isin(ids[q : q + STRIPE], tile_ids)
                        repeats = int(np.unique(tile_ids, return_counts=True)[1].max()) if same.any() else 0
                        row, col = select(scores, k + repeats)
                        other = ids[q + row] != tile_ids[col]
                        row, col = row[other], col[other]
                        lists.merge(q + row, scores[row, col], tile_ids[col])
        yield from _packed(lists, part, 256)

    return run


def _packed(lists: Lists, part: int, chunk: int):
    """Lists as rows (LISTS) of a chunk of queries each."""
    for c in range(0, len(lists.queries), chunk):
        a, b = np.searchsorted(lists.rows, [c, c + chunk])
        if a < b:
            yield pa.RecordBatch.from_pylist([{"chunk": int(lists.queries[c]), "part": part, "queries": lists.queries[lists.rows[a:b]].tobytes(), "scores": lists.scores[a:b].tobytes(), "ids": lists.ids[a:b].tobytes()}], _schema())


@functools.cache
def _schema():
    return pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("queries", pa.binary()), ("scores", pa.binary()), ("ids", pa.binary())])


def _merge(k: int, fan: int):
    import pandas as pd

    def run(key, frame):
        queries = np.concatenate([np.frombuffer(x, np.int64) for x in frame["queries"]])
        names, rows = np.unique(queries, return_inverse=True)
        lists = Lists(names, k)
        lists.merge(rows.astype(np.int64), *(np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("scores", "ids")))
        return pd.DataFrame([{"chunk": int(key[0]), "part": int(key[1]), "queries": names[lists.rows].tobytes(), "scores": lists.scores.tobytes(), "ids": lists.ids.tobytes()}])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries (both vec_id, embedding).

    The queries are gone through in blocks. Each is broadcast, its lists are written to the shared folder, and it's
    taken back before the next one, so driver and executors hold one, and plans stay as long as one block's.
    """
    import pickle

    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    queries = queries.where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    per_block = max(1, query_bytes // (8 * max(most, 1)))
    parts = vectors.rdd.getNumPartitions()
    folder = new_folder(spark, "top_lists")
    for block in _blocks(queries, per_block):
        for _, own, matrix in _vectors(block):
            sent = spark.sparkContext.broadcast(pickle.dumps((own, matrix)))  # query_bytes
            found = vectors.mapInArrow(_search(sent, k), LISTS)
            left = parts
            while left > 1:
                left = -(-left // FAN_IN)
                found = found.groupBy("chunk", (F.col("part") % left).alias("to")).applyInPandas(_merge(k, FAN_IN), LISTS)
            found.write.mode("append").parquet(folder)
            sent.destroy()

    def rows(batches):
        for batch in batches:
            for x in batch.to_pylist():
                q, s, i = (np.frombuffer(x[c], np.int64) for c in ("queries", "scores", "ids"))
                rank = np.arange(len(q)) - np.searchsorted(q, q, "left") + 1
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(i), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    shape = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], LISTS).write.mode("append").parquet(folder)  # there may be no query at all
    return spark.read.schema(LISTS).parquet(folder).mapInArrow(rows, shape)


def _blocks(queries: DataFrame, per_block: int):
    """Arrow batches of at most per_block queries each, one held by the driver at a time."""
    shape = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    held: list = []
    for row in queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toLocalIterator():
        held.append({"vec_id": row[0], "embedding": row[1]})
        if len(held) >= per_block:
            yield pa.RecordBatch.from_pylist(held, shape)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, shape)


def _query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op7_exact_topk": _query}
ORACLE_SQL = {
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
"""
}
