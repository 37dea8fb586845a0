import zlib

import pytest
from pyspark.sql import functions as F

from ipquarry.llm import ngram_lm
from tests.llm.kn_oracle import Oracle

TEXTS = [
    "the cat sat on the mat", "The cat ran", "a dog sat on a mat  and\tsat", "", None, "the dog", "x", "the cat sat on the mat", "dog dog dog dog",
    "é ü é ü the CAT", " ", "\x0b\x0c", "on the mat on the mat on a mat", "a b c d e f g the a the b", "word " * 300, "the the the cat", "mat a on sat", "z y x w v u t",
]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_brute_force(spark, order, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    want = Oracle(train, order)
    model = ngram_lm.train(docs.where(~ngram_lm.held_out()), order)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, model, ngram_lm.held_out()).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        for k, v in want.row(t).items():
            assert got[i][k] == pytest.approx(v, rel=1e-9), (i, t, k)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_shards_and_buffers_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").repartition(2)
    plain = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs), F.lit(False)).collect()}
    monkeypatch.setattr(ngram_lm, "SHARD_PAIRS", 20)
    model = ngram_lm.train(docs)
    assert model.bits > 2
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, model, F.lit(False)).collect()}
    assert got == pytest.approx(plain)


def test_split_contexts_and_wide_keys_against_brute_force(spark, monkeypatch):
    """Contexts that are split over shards, and n-grams of more ids than fit into one integer."""
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "the", "a", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_lm, "SHARD_PAIRS", 100)
    for order in (3, 12):
        train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
        want = Oracle(train, order)
        model = ngram_lm.train(docs.where(~ngram_lm.held_out()), order)
        assert model.bits > 2 and any(len(model.hot[n].have) for n in model.hot)
        for r in ngram_lm.score(docs, model, ngram_lm.held_out()).collect():
            assert r["score"] == pytest.approx(want.row(texts[r["doc_id"]])["score"], rel=1e-9)


def test_a_missing_file_raises(spark):
    import glob
    import os

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for name in ("words", "follows", "2", "3"):
        model = ngram_lm.train(docs)
        gone = glob.glob(f"{model.folder}/{name}-*.bin")
        assert gone
        for path in gone:
            os.remove(path)
        with pytest.raises(Exception, match="FileNotFoundError"):
            ngram_lm.score(docs, model, F.lit(False)).collect()


def test_counts_in_few_bits():
    import numpy as np

    values = np.array([1, 14, 15, 16, 254, 255, 256, 70000, 2, 1 << 40, 3])
    for bits in (4, 8):
        got = ngram_lm._small("x", values, bits)
        at = np.array([10, 0, 9, 3, 2, 1, 5, 7, 8, 4, 6])
        assert ngram_lm._values(got, "x", at, bits).tolist() == values[at].tolist()


def test_directories():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 40000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        arrays = ngram_lm._directory("x", keys)
        asked = np.sort(np.concatenate([keys[::3], rng.integers(0, 1 << 63, 500).astype(np.uint64)]))
        hit, at = ngram_lm._find(arrays, "x", asked)
        assert asked[hit].tolist() == keys[at].tolist() == keys[np.isin(keys, asked)].tolist()


def test_without_rows_and_with_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string, extra int")
    model = ngram_lm.train(none)
    assert ngram_lm.score(none, model, ngram_lm.held_out()).count() == 0
    docs = spark.createDataFrame([(None, "a b", 1), (None, None, 2)], "doc_id long, text string, score int")
    rows = ngram_lm.score(docs, model, ngram_lm.held_out()).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["held_out"]) for r in rows] == [(3, 0, 0, 0.0, True), (1, 0, 0, 0.0, True)]


def test_model_beats_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ngram_lm.QUERIES["op1_ngram_lm"](spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert 0 < len(rows) < docs.count()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_store_must_be_mounted(spark):
    with pytest.raises(ValueError, match="mount"):
        ngram_lm.train(spark.createDataFrame([(1, "a")], "doc_id long, text string"), folder="hdfs://x/y")


def test_the_query_has_trigrams():
    import inspect

    assert inspect.signature(ngram_lm.train).parameters["order"].default >= 3
