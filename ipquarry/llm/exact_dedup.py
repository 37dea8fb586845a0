"""Exact deduplication through cuckoo-filter indexes over bucketed digests.

Texts are equal when they are identical after each run of white space has become one space. Their
SHA-256 is computed JVM-side; what moves is (digest, smallest id, count), one row per digest and Arrow
batch, so a text that a third of all rows share weighs no more than a few rows per task. Digests fall
into buckets by their first bits; the number of buckets follows the rows, about BUCKET_ROWS each, so what a
task holds doesn't grow with the corpus. Each bucket owns a cuckoo filter and the bucket's content, the
full digests with their smallest id and count. A miss in the filter proves a digest new; a hit is
verified against the content, and a false one is inserted like a miss. A filter that can't place a
fingerprint is rebuilt at twice the size from the stored keys.

Deletion takes rows: a digest's count goes down by the rows that leave, and the digest leaves the filter
with its last one. Where the smallest id leaves and others stay, the smallest of those is looked up in
the rows that are left, for these digests only.

Defined results: null texts count as empty; empty texts are equal to each other; rows with a null id
never stay beside a row that has one; rows that repeat the staying id are all marked kept; no rows give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import few, fresh, held, stored, table, texts

SPACE = r"[\x20\x09-\x0D]+"
SLOTS = 4
MAX_KICKS = 64
#: Rows of a bucket, about, and bits of the bucket numbers.
BUCKET_ROWS = 20_000
LEAST_BITS, MOST_BITS = 12, 30


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two possible buckets, found from either one."""

    def __init__(self, n_buckets: int = 16, cells: bytes | None = None):
        self.n = n_buckets
        self.cells = np.zeros((n_buckets, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(n_buckets, SLOTS).copy()

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[-2:], "little") or 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        first = int.from_bytes(digest[8:16], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995 >> 3)) & (self.n - 1)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.cells[a].tolist() or mark in self.cells[b].tolist()

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the filter is then to be rebuilt, as a fingerprint may have lost its place."""
        mark, a, b = self._places(digest)
        cells = self.cells
        for place in (a, b):
            row = cells[place]
            for slot in range(SLOTS):
                if not row[slot]:
                    row[slot] = mark
                    return True
        place = b
        for kick in range(MAX_KICKS):
            slot = (mark + kick) % SLOTS
            mark, cells[place, slot] = int(cells[place, slot]), mark
            place = self._other(place, mark)
            row = cells[place]
            for slot in range(SLOTS):
                if not row[slot]:
                    row[slot] = mark
                    return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests that were inserted."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            for slot in range(SLOTS):
                if self.cells[place, slot] == mark:
                    self.cells[place, slot] = 0
                    return True
        return False


class CuckooIndex:
    """A filter with the content it stands for: digest -> [smallest id or None, rows]."""

    def __init__(self, n_buckets: int = 16):
        self.filter, self.content, self.resizes, self.false_hits = CuckooFilter(n_buckets), {}, 0, 0

    def _resize(self) -> None:
        size = self.filter.n
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(key) for key in self.content):
                return

    def add(self, digest: bytes, keep, rows: int = 1) -> bool:
        """True if the digest is new."""
        if digest in self.filter:
            if (entry := self.content.get(digest)) is not None:
                if keep is not None and (entry[0] is None or keep < entry[0]):
                    entry[0] = keep
                entry[1] += rows
                return False
            self.false_hits += 1
        self.content[digest] = [keep, rows]
        if not self.filter.insert(digest):
            self._resize()
        return True

    def find(self, digest: bytes):
        """The live entry of a digest, or None."""
        return self.content.get(digest) if digest in self.filter else None

    def remove(self, digest: bytes, rows: int | None = None) -> bool:
        """Takes rows of a digest away, by default all; with the last one it goes. False if it isn't live."""
        if digest not in self.filter or (entry := self.content.get(digest)) is None:
            return False
        if rows is not None and rows < entry[1]:
            entry[1] -= rows
            return True
        del self.content[digest]
        return self.filter.delete(digest)

    def pack(self) -> dict:
        return {
            "n_buckets": self.filter.n, "cells": self.filter.cells.tobytes(), "digests": b"".join(self.content),
            "keep_ids": np.array([x[0] or 0 for x in self.content.values()], "<i8").tobytes(), "known": bytes(x[0] is not None for x in self.content.values()),
            "sizes": np.array([x[1] for x in self.content.values()], "<i8").tobytes(),
        }

    @classmethod
    def unpack(cls, row) -> CuckooIndex:
        out = cls(1)
        out.filter = CuckooFilter(int(row["n_buckets"]), bytes(row["cells"]))
        keys = bytes(row["digests"])
        ids, sizes = (np.frombuffer(row[c], "<i8").tolist() for c in ("keep_ids", "sizes"))
        out.content = {keys[32 * i : 32 * i + 32]: [k if known else None, n] for i, (k, known, n) in enumerate(zip(ids, bytes(row["known"]), sizes, strict=True))}
        return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary): SHA-256 of the normalised text."""
    return texts(docs).select("doc_id", F.unhex(F.sha2(F.regexp_replace("text", SPACE, " "), 256)).alias("digest"))


def digest_of(text: str | None) -> bytes:
    """The same in Python, for tests and single look-ups."""
    import re

    return hashlib.sha256(re.sub(SPACE, " ", text or "").encode()).digest()


def bucket_bits(rows: int) -> int:
    """Bits of the bucket numbers for so many rows."""
    return min(MOST_BITS, max(LEAST_BITS, (rows // BUCKET_ROWS).bit_length()))


def _condensed(bits: int):
    """One row for each digest of a batch: (bucket, digest, keep_id, rows)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "min"), ("digest", "count")])
                keys = got["digest"].combine_chunks().cast(pa.binary())
                bucket = pa.array([int.from_bytes(x[:4], "big") >> (32 - bits) for x in keys.to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([bucket, keys, got["doc_id_min"].combine_chunks(), got["digest_count"].combine_chunks()], ["bucket", "digest", "keep_id", "rows"])

    return run


CONDENSED = "bucket int, digest binary, keep_id long, rows long"
INDEX = "bucket int, bits int, n_buckets int, cells binary, digests binary, keep_ids binary, known binary, sizes binary"


def _indexes(batches):
    """The finished index of each bucket, from rows sorted by bucket; one bucket is held at a time."""
    at, index = None, None
    for batch in batches:
        for bucket, digest, keep, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                if index is not None:
                    yield at, index
                at, index = bucket, CuckooIndex()
            index.add(digest, keep, rows)
    if index is not None:
        yield at, index


def _groups(batches):
    for _, index in _indexes(batches):
        keys, entries = list(index.content), list(index.content.values())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x[0] for x in entries], pa.int64()), pa.array([x[1] for x in entries], pa.int64())], ["digest", "keep_id", "group_size"])


def _packed(bits: int):
    shape = pa.schema([("bucket", pa.int32()), ("bits", pa.int32()), ("n_buckets", pa.int32()), ("cells", pa.binary()), ("digests", pa.binary()), ("keep_ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        for bucket, index in _indexes(batches):
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "bits": bits} | index.pack()], shape)

    return run


def _changes(found: DataFrame, bits: int) -> DataFrame:
    return found.select("doc_id", "digest").mapInArrow(_condensed(bits), CONDENSED)


def groups(found: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of (doc_id, digest) rows, resolved by the buckets' indexes."""
    rows = _changes(found, bucket_bits(found.count()))
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "digest binary, keep_id long, group_size long")


def build_index(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """The index of a corpus as a table, one row per bucket (see INDEX); rows: how many it's laid out for, by default its own."""
    bits = bucket_bits(docs.count() if rows is None else rows)
    return _changes(digests(docs), bits).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_packed(bits), INDEX)


def _bits(index: DataFrame) -> int:
    first = index.select("bits").first()
    return bucket_bits(0) if first is None else first["bits"]


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, left: DataFrame) -> DataFrame:
    """The index after the rows of deletes have gone and those of inserts have come.

    Both, and left, the rows of the corpus without those that have gone, are (doc_id, text); of left only
    texts are used that lose their smallest id. Rows of deletes have to be rows of the corpus; those whose
    text isn't live are ignored.
    """
    import pandas as pd

    bits = _bits(index)
    gone = _changes(digests(deletes), bits)
    out_of = held(lookup_digests(index, gone).join(digests(deletes).select("digest", F.col("doc_id").alias("gone_id")), "digest").where(F.col("gone_id").eqNullSafe(F.col("keep_id"))).select("digest").distinct())
    next_ids = digests(left).join(few(out_of), "digest", "left_semi")
    found = _changes(next_ids, bits).groupBy("bucket", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))

    def change(key, old, new):
        at = CuckooIndex.unpack(old.iloc[0]) if len(old) else CuckooIndex()
        kind = {k: new[new["kind"] == k] for k in range(3)}
        for digest, rows in kind[0][["digest", "rows"]].itertuples(index=False):
            at.remove(bytes(digest), int(rows))
        for digest, keep in kind[1][["digest", "keep_id"]].itertuples(index=False):
            if (entry := at.find(bytes(digest))) is not None:
                entry[0] = None if pd.isna(keep) else int(keep)
        for digest, keep, rows in kind[2][["digest", "keep_id", "rows"]].itertuples(index=False):
            at.add(bytes(digest), None if pd.isna(keep) else int(keep), int(rows))
        return pd.DataFrame([{"bucket": int(key[0]), "bits": bits} | at.pack()])

    changes = gone.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1))).unionByName(_changes(digests(inserts), bits).withColumn("kind", F.lit(2)))
    changes = changes.withColumn("keep_id", F.col("keep_id").cast("decimal(19,0)"))  # pandas makes floats of longs with nulls
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(change, INDEX)


def lookup_digests(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of those digests of asked, (bucket, digest) rows, that are live in the index."""

    def look(old, asked):
        import pandas as pd

        if not len(old):
            return pd.DataFrame({"digest": [], "keep_id": pd.array([], "Int64"), "group_size": []})
        at = CuckooIndex.unpack(old.iloc[0])
        hits = [(bytes(d), e) for d in dict.fromkeys(map(bytes, asked["digest"])) if (e := at.find(d)) is not None]
        return pd.DataFrame({"digest": [d for d, _ in hits], "keep_id": pd.array([e[0] for _, e in hits], "Int64"), "group_size": [e[1] for _, e in hits]})

    return index.groupBy("bucket").cogroup(asked.select("bucket", "digest").groupBy("bucket")).applyInPandas(look, "digest binary, keep_id long, group_size long")


def lookup(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of those texts of docs that are live in the index."""
    return lookup_digests(index, _changes(digests(docs), _bits(index)))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = stored(digests(docs), "digests")  # its rows are counted, moved and joined
    # The join's shuffles are its own, so that adaptive execution can split the partition of a hot digest.
    out = found.join(groups(found), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each distinct text.

    What leaves is joined against docs, not what stays, so that texts needn't move where copies are few.
    Rows that repeat both an id and its text are copies too; one of them stays.
    """
    own, other, key = fresh(docs, "digest"), fresh(docs, "other_id"), fresh(docs, "other_digest")
    marked = docs.withColumn(own, F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " "), 256)))
    doc_id = F.col("doc_id").cast("long")
    found = stored(marked.select(doc_id.alias("doc_id"), F.col(own).alias("digest")), "digests")
    judged = found.groupBy("doc_id", "digest").agg(F.count("*").alias("times")).join(groups(found), "digest")
    judged = judged.select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "times")
    odd = held(judged.where("not kept or times > 1"))
    gone, again = (odd.where(test).select(F.col("doc_id").alias(other), F.col("digest").alias(key)) for test in ("not kept", "kept"))
    same = doc_id.eqNullSafe(F.col(other)) & (F.col(own) == F.col(key))
    out = marked.join(few(gone), same, "left_anti")
    if not again.isEmpty():
        once = out.join(few(again), same, "left_semi").dropDuplicates(["doc_id", own])
        out = out.join(few(again), same, "left_anti").unionByName(once)
    return out.drop(own)


QUERIES = {"op3_exact_dedup": lambda spark, sf_dir: exact_dedup(table(spark, sf_dir, "documents"))}
ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
}
