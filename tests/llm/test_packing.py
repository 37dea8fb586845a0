import zlib
from collections import defaultdict

import numpy as np
import pytest

from ipquarry.llm import packing

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("kind", ["even", "long", "short", "few", "one", "none", "cut"])
def test_plans_are_whole_and_tight(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 1025, 20000), "long": rng.integers(600, 1025, 3000), "short": rng.integers(1, 50, 5000), "few": np.array([700, 400, 300, 1, 1, 1024]),
        "one": np.array([1] * 5000), "none": np.zeros(0, int), "cut": np.minimum(1024, rng.lognormal(6, 1, 20000).astype(int) + 1),
    }[kind]
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.plan(histogram)
    filled = defaultdict(list)
    for n, _, times, first, offset in runs.tolist():
        for i in range(times):
            filled[first + i].append((offset, n))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for n, c in histogram.items():
        own = runs[runs[:, 0] == n]
        assert own[:, 2].sum() == c and (np.append(own[:, 1], c)[1:] == own[:, 1] + own[:, 2]).all()
    least = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert len(filled) <= least * 1.02 + 1


def test_nnls_reproduces_a_mix_of_patterns():
    shapes = packing.patterns(np.arange(1, 64), 64)
    assert (shapes.sum(1) == 64).all()
    true = np.zeros(len(shapes))
    true[[3, 50, 200]] = [100, 40, 7]
    used = shapes > 0
    counts = np.bincount(shapes[used], true[np.nonzero(used)[0]], 65)
    x = packing.fit(shapes, counts, 3000)
    assert (x >= 0).all()
    assert np.abs(np.bincount(shapes[used], x[np.nonzero(used)[0]], 65) - counts).max() < 0.5


def test_packs_every_document(spark):
    texts = ["", None, "short", "<|endoftext|> a <|endoftext|>", "word " * 3000, "é" * 2500, *(f"text {i} " * (i % 90) for i in range(300)), "same", "same"]
    rows = [*enumerate(texts), (5, texts[5])]  # one row twice
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int").repartition(4)
    got = packing.pack(docs).collect()
    tokenizer = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(filled) <= -(-total // 1024) * 1.05 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_ids_of_odd_strings_are_those_of_the_tokenizers_library():
    import random

    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(7)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path(packing.RANKS)
    parts = ["<|endoftext|>", "<|endof", "text|>", "‍", " ", " ", "　", "\x0b", "\x0c", "\x85", " ", "  ", "\n", "\r\n", "\t", "'s", "'LL", "’s", "ſ", "İ", "ß", "ﬁ", "é", "१२", "٣", "Ⅷ", "½", "🙂", "👩‍💻", "\U0010ffff", "﻿", "word", "Word", "123", "!?", "_", "日本", "한"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([x for x in (rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000))])) for _ in range(rng.randrange(1, 9)))
        assert packing.encode(path, text)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
