"""One text of more than a megabyte through every operator that reads texts."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from ipquarry.llm import byte_bpe, exact_dedup, licenses, near_dup, ngram_lm, packing, quality, secrets, token_counts
from tests.llm.kn_oracle import Oracle
from tests.llm.test_duplicates import normal, oracle
from tests.llm.test_licenses import base as license_base
from tests.llm.test_pipeline import held
from tests.llm.test_secrets import base as secret_base
from tests.llm.test_secrets import said

RNG = random.Random(3)
LONG = " ".join(f"w{RNG.randrange(30000)}" + (" é\t" if i % 97 == 0 else "") for i in range(190_000)) + " token=abcdef123456 all rights reserved"
NEAR = LONG.replace(" w1 ", " changed ", 3) + " end"
GLUED = "".join(RNG.choice("abcdef ghij") if i % 50 else "x" for i in range(1000)) + "y" * 1_100_000  # a word of a megabyte
ROWS = [(1, LONG), (2, NEAR), (3, GLUED), (4, LONG.replace(" ", "  ")), (5, "short text"), (6, None)]


@pytest.fixture(scope="module")
def docs(spark):
    assert min(len(t) for _, t in ROWS[:4]) > 1 << 20
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).cache()


def test_model(docs):
    texts = [t for _, t in ROWS]
    want = Oracle(texts, 3)
    from pyspark.sql import functions as F

    for r in ngram_lm.score(docs, ngram_lm.train(docs), F.lit(False)).collect():
        own = want.row(texts[r["doc_id"] - 1])
        assert (r["n_tokens"], r["n_known"]) == (own["n_tokens"], own["n_known"])
        assert r["score"] == pytest.approx(own["score"], rel=1e-9) and r["base_score"] == pytest.approx(own["base_score"], rel=1e-9)


def test_tokens(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in ROWS}
    texts = dict(ROWS)
    for r in byte_bpe.round_trip(docs).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids[r["doc_id"]])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.lengths(docs).collect()} == {i: len(x) for i, x in ids.items()}
    rows = held(packing.pack(docs).collect())
    for i, x in ids.items():
        own = [r for r in rows if r[0] == i]
        assert sum(r[3] for r in own) == len(x) + 1 and [r[2] for r in own] == packing.cuts(len(x) + 1, 1024)[:-1]


def test_exact(docs):
    for r in exact_dedup.exact_dedup(docs).collect():
        assert r["text_sha256"] == hashlib.sha256(normal(dict(ROWS)[r["doc_id"]]).encode()).hexdigest()
        assert r["keep_id"] == (1 if r["doc_id"] == 4 else r["doc_id"])


def test_near(docs):
    got = near_dup.near_duplicates(docs, 3, (90, 100)).drop("n_links").collect()
    assert sorted(tuple(r) for r in got) == sorted(oracle(ROWS, 3, 90, 100))
    assert sorted(r["doc_id"] for r in near_dup.drop_near_duplicates(docs).collect()) == [1, 3, 5, 6]


def test_licences_and_secrets(docs):
    texts = dict(ROWS)
    for r in licenses.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_base(texts[r["doc_id"]])
    for r in secrets.report(docs).collect():
        assert r["base_sha256"] == hashlib.sha256(said(secret_base(texts[r["doc_id"]])).encode()).hexdigest()


def test_quality(docs):
    model = quality.Model()
    for r in quality.score(docs, model).collect():
        x, first = quality.passages(pa.array([dict(ROWS)[r["doc_id"]]], pa.string()))
        assert r["score"] == pytest.approx(float(model.forward(x, first)["p"][0]), abs=1e-6)
    words = len(re.findall(r"[^\x20\x09-\x0D]+", LONG))
    assert len(quality.passages(pa.array([LONG]))[0]) == -(-words // quality.PASSAGE)
