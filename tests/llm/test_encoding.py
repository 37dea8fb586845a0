import base64
import hashlib

import numpy as np
import pytest

from ipquarry.llm import byte_bpe, packing, token_counts

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, "plain words", "naïve café — 東京 🎉🎉", "<|endoftext|> in the text <|endoftext|>", "\x00\x01\x7f tab\t\n\r\n  ", "a" * 5000, " " * 3000, "é" * 1000, "don't we'll I'd", "12345 ٣٤ ½", "x‍y﻿"]


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def documents(spark, extra=()):
    rows = [(i, t) for i, t in enumerate([*ODD, *extra])]
    return rows, spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, n_tokens string, score long").repartition(3)


def test_round_trip_as_tiktoken(spark):
    rows, docs = documents(spark)
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs).collect()}
    own = tiktoken_encoding()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_corpus_as_tiktoken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = tiktoken_encoding()
    got = {r["doc_id"]: r["ids_sha256"] for r in byte_bpe.round_trip(docs).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(np.array(own.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest() for r in docs.collect()}


def test_ids_and_offsets(spark):
    rows, docs = documents(spark)
    encoded = byte_bpe.encode_documents(docs, offsets=True)
    texts = dict(rows)
    for r in encoded.collect():
        text = texts[r["doc_id"]] or ""
        raw, table = text.encode(), byte_bpe.token_bytes(byte_bpe.vocabulary_path())
        assert len(r["ids"]) == len(r["byte_start"])
        for i, a, b, c, d in zip(r["ids"], r["byte_start"], r["byte_end"], r["char_start"], r["char_end"]):
            assert raw[a:b] == table[i]
            assert raw[a:b] in text[c:d].encode()
            assert d - c >= 1
            if d - c > 1:  # no narrower span of characters holds the bytes
                assert len(text[:c].encode()) <= a < len(text[: c + 1].encode())
                assert len(text[: d - 1].encode()) < b <= len(text[:d].encode())
    back = {r["doc_id"]: r for r in byte_bpe.decode_documents(encoded).collect()}
    assert all(bytes(back[i]["text"]).decode() == (t or "") and back[i]["valid"] for i, t in rows)


def test_split_characters_decode(spark):
    path = byte_bpe.vocabulary_path()
    ids = next(byte_bpe.encode(path, ["🎉"])).tolist()
    assert len(ids) > 1
    halves = spark.createDataFrame([(1, ids[:1]), (2, ids)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r for r in byte_bpe.decode_documents(halves).collect()}
    assert not got[1]["valid"] and got[2]["valid"] and bytes(got[2]["text"]).decode() == "🎉"


def test_byte_table_is_a_bijection():
    assert sorted(byte_bpe.byte_table().values()) == list(range(256))


def test_both_libraries_agree_on_every_code_point():
    path, ranks = byte_bpe.vocabulary_path(), P.path(packing.RANKS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::17]
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}.{chr(c)}{chr(c)}b  {chr(c)}" for c in points]
    for text, ids in zip(texts, byte_bpe.encode(path, texts)):
        assert ids.tolist() == packing.encode(ranks, text)[:-1].tolist(), repr(text)


def test_length_sums(spark):
    _, docs = documents(spark, ["w " * n for n in range(40)] + ["z " * 3000])
    counted = token_counts.lengths(docs)
    lengths = [r["n_tokens"] for r in counted.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(counted)).cache()
    rows = sums.collect()
    assert [r["n_tokens"] for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_upto"] == sum(x <= n for x in lengths) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_upto"] == sum(x for x in lengths if x <= n) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["total_tokens"] == sum(lengths) and r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 1, 7, 500, 100000):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) - 1) // 2]
    none = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs.limit(0))))
    assert none.count() == 0 and token_counts.truncated_total(none, 5) == 0
