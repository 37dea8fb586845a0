import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ipquarry.llm import quality as Q


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = Q.Model(width=5)
    for k in Q.Model.NAMES:
        setattr(model, k, getattr(model, k).astype(float))
    model.mean, model.std = np.zeros(Q.N_FEATURES), np.ones(Q.N_FEATURES)
    x, first, y = rng.standard_normal((9, Q.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = model.gradients(x, first, y)
    for k in Q.Model.NAMES:
        value = getattr(model, k)
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert grads[k][at] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-6), (k, at)


def test_attention_sums_to_one():
    model = Q.Model()
    x, first = Q.passages(pa.array(["a b c " * 200, "", None, "x"]))
    f = model.forward(x, first)
    assert np.add.reduceat(f["a"], first[:-1]) == pytest.approx(1)
    assert len(f["p"]) == 4


def test_passages_take_the_whole_text():
    text = " ".join(f"word{i}" for i in range(Q.PASSAGE * 3 + 5))
    x, first = Q.passages(pa.array([text, "", "one"]))
    assert first.tolist() == [0, 4, 5, 6]
    assert x[4].any() == False and x[5, -1] == 1  # noqa: E712
    changed, _ = Q.passages(pa.array([text + "!!!!"]))
    assert (changed[:3] == x[:3]).all() and (changed[3] != x[3]).any()
    parts, _ = Q.passages(pa.array(["zzz", text]))
    assert (parts[1:] == x[:4]).all()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = Q.QUERIES["op6_quality_mil"](spark, sf_dir).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_edge_rows(spark):
    good, bad = "The good plain words of a text. " * 5, "### !!! $$$ ### " * 10
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(60, None), (61, ""), (None, good), (1, good), (62, "x" * 50000)]
    docs = spark.createDataFrame([(i, t, "clash", 5.0) for i, t in rows], "doc_id long, text string, predicted string, y double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] is None)["held_out"]
    kept = Q.keep(docs, model)
    assert kept.columns == docs.columns and kept.where(F.col("text") == bad).count() == 0 and kept.where(F.col("text") == good).count() == 32
    none = Q.score(docs.limit(0), model)
    assert none.count() == 0
    assert {r["score"] for r in Q.score(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}
    one_kind = Q.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in Q.score(docs, one_kind).collect()} == {1.0}


def test_labels_are_no_inputs(spark):
    docs = spark.createDataFrame([(1, "same text here", "en", "a"), (2, "same text here", "de", "b")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scores = {r["score"] for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    assert len(scores) == 1


def test_fitting_takes_every_passage(spark, monkeypatch):
    sizes = {1: 10, 2: Q.PASSAGE * 100 + 1, 3: Q.PASSAGE * 40}
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n))) for i, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, quality int")
    held, seen = {r[0] for r in docs.where(Q.held_out()).select("doc_id").collect()}, []
    monkeypatch.setattr(Q.Model, "fit", lambda self, bags, y: seen.extend(map(len, bags)) or self)
    Q.fit(docs, labels)
    assert 2 not in held and sorted(seen) == sorted(-(-n // Q.PASSAGE) for i, n in sizes.items() if i not in held)


def plain_passages(text):
    """Features of every passage by loops over bytes and words."""
    import math
    import re

    def kind(byte):
        for i, own in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c", b"\n\r", b".", b",;:", b"!?", b"|<>{}[]()")):
            if byte in own:
                return i
        return 10 if byte in b"\"'-" else 11 if byte == 0xC3 else 12 if 0x80 <= byte < 0xC0 else 9

    raw = (text or "").encode()
    words = [(m.start(), bytes(c + 32 if 65 <= c <= 90 else c for c in m[0])) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    starts = [a for a, _ in words] + [len(raw)]
    out = []
    for p in range(max(1, -(-len(words) // Q.PASSAGE))):
        at = range(p * Q.PASSAGE, min(len(words), (p + 1) * Q.PASSAGE))
        part = raw[starts[at[0]] if p else 0 : starts[at[-1] + 1] if at else len(raw)]
        pairs = [0.0] * 169
        for x, y in zip(part, part[1:]):
            pairs[kind(x) * 13 + kind(y)] += 1
        row = [math.sqrt(c / max(1, sum(pairs))) for c in pairs]
        own, n = [words[i][1] for i in at], len(at)
        sizes = [min(64, starts[i + 1] - starts[i]) for i in at]
        mean = sum(sizes) / max(1, n)
        row += [
            sum(x == y for x, y in zip(own, own[1:])) / max(1, n), len(set(own)) / max(1, n), mean / 16,
            math.sqrt(max(0, sum(x * x for x in sizes) / max(1, n) - mean * mean)) / 16, math.log1p(n) / 5, float(n > 0),
        ]
        out.append(row)
    return out


def plain_score(model, text):
    """The score by loops over passages and units."""
    import math

    def layer(x, weights):
        return [sum(float(x[i]) * float(weights[i][j]) for i in range(len(x))) for j in range(len(weights[0]))]

    encoded, logits = [], []
    for row in plain_passages(text):
        scaled = [(x - float(m)) / float(s) for x, m, s in zip(row, model.mean, model.std)]
        e = [math.tanh(h + float(b)) for h, b in zip(layer(scaled, model.W), model.b)]
        gated = [math.tanh(t) / (1 + math.exp(-g)) for t, g in zip(layer(e, model.V), layer(e, model.U))]
        encoded.append(e)
        logits.append(sum(float(w) * x for w, x in zip(model.w, gated)))
    weights = [math.exp(x - max(logits)) for x in logits]
    z = [sum(w * e[j] for w, e in zip(weights, encoded)) / sum(weights) for j in range(len(encoded[0]))]
    return 1 / (1 + math.exp(-(sum(float(o) * x for o, x in zip(model.o, z)) + float(model.c[0]))))


def test_scores_against_loops(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()][:40] + ["", None, "one", " lead", "a a a b ", "é É \x0b ü|<>", "x" * 300, "w " * 200]
    for text, own in zip(texts, [Q.passages(pa.array([t], pa.string())) for t in texts]):
        assert own[0] == pytest.approx(np.array(plain_passages(text)), abs=1e-5)
    model = Q.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model.prior is None
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in Q.score(rows, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-4)


def test_bounds_of_fitting(spark, monkeypatch):
    rows = [(i % 300, f"text {i} " * (1 + i % 7)) for i in range(1200)]  # ids repeat four times
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(i, 1 - i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q.Model, "fit", lambda self, bags, y: seen.append(len(bags)) or self)
    Q.fit(docs, labels, max_train=40)
    Q.fit(docs, labels)
    usable = [r[0] for r in labels.where(~Q.held_out()).select("doc_id").collect()]
    assert seen == [40, len(usable)]
    few = Q.chosen(docs, labels, 10**6, 400)
    sizes = {i: max(len(t) for j, t in rows if j == i) for i in range(300)}
    assert 0 < sum(sizes[r["doc_id"]] for r in few.collect()) <= 400
    assert Q.chosen(docs, labels, 10**6, 0).count() == 1
