"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, PASSAGE words each, the last one shorter; every passage of the whole
text takes part. A passage is encoded by the rates of byte-class pairs (letters of either case, digits,
kinds of punctuation and white space, bytes beyond ASCII), of repeated and distinct words, and by word
lengths, then by a learned tanh layer. Gated attention weighs the passages,

    a = softmax(w . (tanh(V e) * sigmoid(U e))),  score = sigmoid(o . sum(a e) + c),

and all parameters are learned from the labels of documents by Adam on the log loss. Weights depend on
the passage, so a document that is clean for a page and junk for ten is told from one that isn't.

Fitting uses at most MAX_TRAIN labelled rows, the ones with the smallest hash of their id, as far as their
texts come to MAX_TRAIN_BYTES together, and every passage of each; the bounds concern fitting only. Scoring
reads every passage of every document. Only the text is an input.

Defined results: null texts count as empty; an empty text is one passage of zeros and gets a score like
any other; null or unknown labels aren't learned from; an id that has both labels is learned with both;
of rows of documents that repeat an id, the one with the least text is learned from;
rows with a null id are never learned from (held_out is true); with no usable label, or only one kind,
the score is the share of label 1 (0.5 without labels); repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import table, texts, trim
from ipquarry.llm.wordhash import WINDOW, buffer, slices, words

PASSAGE = 64
THRESHOLD = 0.3
#: Labelled rows that are learned from, and bytes of their texts, at most; the first row is taken whatever its length.
MAX_TRAIN, MAX_TRAIN_BYTES = 6000, 128 << 20
WIDTH = 24
EPOCHS = 30
BATCH = 256

_CLASSES = 13
_CLASS = np.full(256, 9, np.int64)
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c", b"\n\r", b".", b",;:", b"!?", b"|<>{}[]()")):
    _CLASS[list(_bytes)] = _i
_CLASS[list(b"\"'-")] = 10
_CLASS[0xC3] = 11  # leads the accented letters of Latin-1
_CLASS[0x80:0xC0] = 12
N_FEATURES = _CLASSES * _CLASSES + 6


def passages(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Raw features of every passage [passages, N_FEATURES] and the first passage of each row [rows + 1]."""
    raw, bounds = buffer(texts_)
    hashes, starts, upto = words(raw, bounds)
    per = np.diff(upto)
    count = np.maximum(1, -(-per // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    out = np.zeros((n, N_FEATURES), np.float32)
    row = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(hashes)) - upto[row]
    of = first[row] + place // PASSAGE
    # a passage's bytes run from its first word (the row's begin for the first) to the next passage's
    begin = np.repeat(bounds[:-1], count)
    if len(hashes):
        opens = (place % PASSAGE == 0) & (place > 0)
        begin[of[opens]] = starts[opens]
    owner = np.repeat(np.arange(n), np.diff(np.append(begin, bounds[-1])))
    if len(raw) > 1:
        kind = _CLASS[raw]
        pair = owner[:-1] * (_CLASSES * _CLASSES) + kind[:-1] * _CLASSES + kind[1:]
        same = owner[:-1] == owner[1:]
        rate = np.bincount(pair[same], minlength=n * _CLASSES * _CLASSES).reshape(n, -1).astype(np.float32)
        out[:, : _CLASSES * _CLASSES] = np.sqrt(rate / np.maximum(1, rate.sum(1, keepdims=True)))
    if len(hashes):
        size = np.bincount(of, minlength=n)
        some = np.maximum(size, 1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((hashes, of))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        ends = np.append(starts[1:], len(raw))
        length = np.minimum(np.minimum(ends, bounds[row + 1]) - starts, 64).astype(float)
        mean = np.bincount(of, length, n) / some
        tail = out[:, _CLASSES * _CLASSES :]
        tail[:, 0] = np.bincount(of, again, n) / some
        tail[:, 1] = np.bincount(of[order], new, n) / some
        tail[:, 2] = mean / 16
        tail[:, 3] = np.sqrt(np.maximum(0, np.bincount(of, length * length, n) / some - mean * mean)) / 16
        tail[:, 4] = np.log1p(size) / 5
        tail[:, 5] = size > 0
    return out, first


def _softmax(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(first)
    top = np.repeat(np.maximum.reduceat(logits, first[:-1]), count)
    e = np.exp(logits - top)
    return e / np.repeat(np.add.reduceat(e, first[:-1]), count)


class Model:
    """Gated attention over bags; parameters are plain arrays, so that it can be sent to workers."""

    NAMES = ("W", "b", "V", "U", "w", "o", "c")

    def __init__(self, seed: int = 0, width: int = WIDTH):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.std, self.prior = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), None
        self.W, self.b = scale(N_FEATURES, width), np.zeros(width, np.float32)
        self.V, self.U, self.w = scale(width, width), scale(width, width), scale(width)
        self.o, self.c = scale(width), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        e = np.tanh(((x - self.mean) / self.std) @ self.W + self.b)
        t, g = np.tanh(e @ self.V), 1 / (1 + np.exp(-(e @ self.U)))
        a = _softmax((t * g) @ self.w, first)
        z = np.add.reduceat(a[:, None] * e, first[:-1], 0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.o + self.c[0], -30, 30)))
        return {"e": e, "t": t, "g": g, "a": a, "z": z, "p": p}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        f, count = self.forward(x, first), np.diff(first)
        d = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * self.o, count, 0)
        da = (dz * f["e"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), count))
        dt = ds[:, None] * self.w * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * self.w * f["t"] * f["g"] * (1 - f["g"])
        de = f["a"][:, None] * dz + dt @ self.V.T + dg @ self.U.T
        dh = de * (1 - f["e"] ** 2)
        return {
            "W": ((x - self.mean) / self.std).T @ dh, "b": dh.sum(0), "V": f["e"].T @ dt, "U": f["e"].T @ dg,
            "w": ((f["t"] * f["g"]) * ds[:, None]).sum(0), "o": d @ f["z"], "c": np.array([d.sum()], np.float32),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
        self.prior = None if len(set(labels.tolist())) > 1 else (float(labels.mean()) if len(labels) else 0.5)
        if self.prior is not None:
            return self
        n = sum(map(len, bags))
        total, squares = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for bag in bags:
            bag = bag.astype(np.float64)
            total += bag.sum(0)
            squares += (bag * bag).sum(0)
        self.mean = (total / n).astype(np.float32)
        self.std = (np.sqrt(np.maximum(0, squares / n - (total / n) ** 2)) + 0.02).astype(np.float32)
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
                step += 1
                for k, grad in self.gradients(np.concatenate([bags[i] for i in some]).astype(np.float32), first, labels[some]).items():
                    grad = grad + decay * getattr(self, k)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    now = rate * (1 - epoch / epochs)
                    setattr(self, k, (getattr(self, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def score(self, texts_: pa.Array) -> np.ndarray:
        """Of every row of a string array."""
        out = np.zeros(len(texts_))
        for at, n in slices(texts_, WINDOW):
            if self.prior is not None:
                out[at : at + n] = self.prior
            else:
                out[at : at + n] = self.forward(*passages(texts_.slice(at, n)))["p"]
        return out


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def chosen(docs: DataFrame, labels: DataFrame, max_train: int, max_bytes: int) -> DataFrame:
    """(doc_id, y) of the labelled rows that are learned from, max_train at most."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out()).dropDuplicates()
    ids = usable.orderBy(F.xxhash64("doc_id"), "y").limit(max_train)
    sized = texts(docs).select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(ids), "doc_id")  # max_train rows
    rows = sized.groupBy("doc_id", "y").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "y").collect()
    upto = np.cumsum([r["size"] for r in rows])
    kept = [(r["doc_id"], r["y"]) for i, r in enumerate(rows) if not i or upto[i] <= max_bytes]
    return docs.sparkSession.createDataFrame(kept, "doc_id long, y int")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """A model from the labelled rows that aren't held out; the bounds concern fitting only."""
    taken = texts(docs).join(F.broadcast(chosen(docs, labels, max_train, max_bytes)), "doc_id")  # max_train rows
    taken = taken.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for at, n in slices(column, WINDOW):
                x, first = passages(column.slice(at, n))
                bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("y").slice(at, n), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])

    rows = taken.mapInArrow(run, "doc_id long, y int, bag binary").orderBy("doc_id", "y").collect()  # max_train rows
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, N_FEATURES) for r in rows]
    model = Model().fit(bags, np.array([r["y"] for r in rows], np.float32))
    del rows, bags
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own = pickle.loads(sent.value)
        for batch in batches:
            trim()
            p = own.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text isn't rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index("text")

    def run(batches):
        own = pickle.loads(sent.value)
        for batch in batches:
            trim()
            yield batch.filter(pa.array(own.score(batch.column(at).cast(pa.string())) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def _query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_mil": _query}
ORACLE_SQL: dict[str, str] = {}
