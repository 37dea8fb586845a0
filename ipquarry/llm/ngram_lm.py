"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped files.

Tokens: runs of non-space bytes, A-Z lower-cased, then one end per text. Texts begin with order - 1
begin marks, which are context only.

Vocabulary. Words, as 64-bit hashes, are counted first and written as sorted arrays in shards of the hash.
A word's id is its place in an order by the power of two of its count, then by shard and hash: frequent
words have small ids, which makes what is shuffled small, and an id says within a factor of two how
frequent the word is.

Counting. A task looks its words up, sorts a buffer of n-grams and sends each shard the distinct ones with
their counts as compressed columns of ids: repeated text weighs once per buffer. Shards are ranges of the
context's hash and their number follows the size of the corpus, so that a shard has about SHARD_PAIRS
tokens. Where the counts of a context's words allow it more than SHARD_PAIRS / HOT_PARTS followers, it's
split by the follower's hash over several shards, and the sums of its parts are added up in a second step;
so no task gets all followers of a frequent context. The task of a shard adds up, writes the shard's file and
passes on the level below: for every distinct n-gram one (shorter context, word) continuation. Each level's
rows are written to the shared folder and the level above's removed. Only counts of counts, a few numbers
for each shard, reach the driver.

Files. A shard's file is a header and sorted hash arrays: n-grams with their counts, contexts seen once,
other contexts with their totals and N1, N2, N3+. Of a hash, the bits that the shard and a directory of its
first bits leave, 40, are kept; counts have a few bits and a list of the larger ones. Files lie in the folder
that all workers share (spark.checkpoint.dir, which has to be a mounted path; another can be given) and are
written under another name first, so a task that runs twice leaves one whole file. The model lists them; one
that a worker doesn't find raises an error. Workers map them and look up sorted keys, which touches each page
once for each batch.

Estimates. p(w|h) = max(c - D(c), 0) / c(h.) + gamma(h) p(w|h'), modified discounts D1, D2, D3+ per level
from its counts of counts; the words' own level has continuation counts and ends on 1 / (V + 1). Unseen
contexts leave all to the level below. Discounts without enough counts are 0.5, 1 and 1.5.

N-grams are counted by ids; only words are taken by their hashes. A look-up of an n-gram that isn't there
finds another one in its place once in some 10 ** 11 times.

Defined results: null texts count as empty: one token, the end; rows with a null id are held out;
repeated rows count as often as they occur; without training rows every score is 0 for base (V = 0,
N = 0) and model; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import drop, new_folder, stored, table, texts, trim
from ipquarry.llm.planes import joined, narrow, split
from ipquarry.llm.wordhash import WINDOW, buffer, mix, slices, words

ORDER = 3
#: Tokens that a task sorts at once, and tokens for each shard, about.
BUFFER = 1_500_000
SHARD_PAIRS = 1_500_000
#: A context may have a shard's tokens divided by this before it's split.
HOT_PARTS = 8
#: Entries for each place of a directory, and bits of a hash beyond it.
PER_PLACE, REST = 16, 40
_END = np.uint64(0x0E0E0E0E0E0E0E0E)
#: Ids of begin marks and of words that aren't in the vocabulary.
_BEGIN, _UNKNOWN = np.uint64(0), np.uint64((1 << 62) - 1)
_CLASSES = 64


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the rows, ends included; each token's row and place in it; the first token of each row [rows + 1]."""
    hashes, _, upto = words(*buffer(column))
    rows = len(upto) - 1
    first = upto + np.arange(rows + 1)
    out = np.full(int(first[-1]), _END, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    place = np.arange(len(out)) - first[row]
    out[place < np.diff(upto)[row]] = hashes
    return out, row, place, first


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.nonzero(new)[0]


class Columns:
    """n-grams as columns of ids, packed into one integer each by their places among the distinct ids.

    ids: the distinct ones in order; keys: packed. Where they don't fit into 64 bits, keys are numbers in order.
    """

    def __init__(self, ids: np.ndarray, local: list[np.ndarray]):
        self.ids, self.n, self.width = ids, len(local), max(1, int(len(ids)).bit_length())
        if self.n * self.width <= 64:
            self.keys = functools.reduce(lambda a, b: (a << np.uint64(self.width)) | b, (c.astype(np.uint64) for c in local))
            self.local = None
        else:
            order = np.lexsort(local[::-1])
            new = np.zeros(len(order), bool)
            for c in local:
                new[1:] |= c[order][1:] != c[order][:-1]
            self.keys = np.empty(len(order), np.uint64)
            self.keys[order] = np.cumsum(new)
            self.local = [c[order[np.append(0, np.nonzero(new)[0])]] for c in local]

    def column(self, i: int, keys: np.ndarray) -> np.ndarray:
        """Places among ids of the i-th column of keys."""
        if self.local is not None:
            return self.local[i][keys.astype(np.int64)]
        return ((keys >> np.uint64(self.width * (self.n - 1 - i))) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def columns(self, keys: np.ndarray) -> list[np.ndarray]:
        """Columns of ids of keys."""
        return [self.ids[self.column(i, keys)] for i in range(self.n)]


def _placed(columns: list[np.ndarray]) -> Columns:
    """Columns of ids, packed."""
    ids, at = np.unique(np.concatenate(columns), return_inverse=True)
    return Columns(ids, np.split(at, len(columns)))


def _before(local: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of the order - 1, ..., 1 tokens before each token, 0 where a text has none, and of the token."""
    out = [local]
    for back in range(1, order):
        before = np.zeros(len(local), local.dtype)
        if back < len(local):
            before[back:] = np.where(place[back:] >= back, local[:-back], 0)
        out.insert(0, before)
    return out


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for c in columns:
        h = mix(h ^ mix(c + np.uint64(0x13198A2E03707344)))
    return h


class Layout:
    """Where n-grams lie: the number of shards, and how frequent words can be by their ids."""

    def __init__(self, bits: int, hot: int, starts: list[int], rows: int):
        self.bits, self.hot, self.starts, self.rows = bits, max(1, hot), np.array(starts, np.uint64), rows

    def most(self, ids: np.ndarray) -> np.ndarray:
        """Upper bounds of the words' counts."""
        power = _CLASSES - np.searchsorted(self.starts, ids, "right")  # of the class, 0 for counts of 1
        out = np.left_shift(np.int64(1), np.minimum(power + 1, 62)).astype(np.int64)
        return np.where(ids == _BEGIN, self.rows, out)

    def parts(self, context: list[np.ndarray]) -> np.ndarray:
        """Over how many shards the followers of contexts go."""
        return 1 + functools.reduce(np.minimum, (self.most(c) for c in context)) // self.hot

    def place(self, columns: list[np.ndarray], context: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Shards of n-grams; context: the hashes of their contexts."""
        part = (mix(columns[-1] + np.uint64(0xA4093822299F31D0)) % parts.astype(np.uint64)).astype(np.uint64)
        return _shard(np.where(parts > 1, mix(context + np.uint64(1) + part), context), self.bits)


# rows that are shuffled

_ROWS = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])
ROWS = "level int, shard int, data binary"
#: Level of the rows with parts of split contexts of a level, over the level itself.
_HOT = 100


def _batch(rows) -> pa.RecordBatch:
    level, shard, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())], schema=_ROWS)


def _dealt(level: int, shard: np.ndarray, columns: list[np.ndarray]):
    """Rows (level, shard, data) of columns; within a shard their order stays."""
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    at = np.append(_runs(shard), len(shard)).tolist()
    for a, b in zip(at, at[1:], strict=False):
        yield level, int(shard[a]), joined([c[a:b] for c in columns])


# files


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A shard's file; renamed into place when whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    top = json.dumps(head).encode()
    top = struct.pack("<Q", -(-(8 + len(top)) // 64) * 64) + top
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(top.ljust(-(-len(top) // 64) * 64, b" "))
        for x in arrays.values():
            out.write(x.tobytes())
            out.write(b"\0" * (-x.nbytes % 64))
    os.replace(part, path)


def _mapped(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)  # plain arrays, of which slices are cheap
    body = struct.unpack("<Q", raw[:8].tobytes())[0]
    head = json.loads(raw[8:body].tobytes())
    return {k: raw[body + at : body + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def _directory(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes as a directory of their first bits and REST bits of what is left."""
    bits = max(0, math.ceil(math.log2(max(1, len(keys) / PER_PLACE))))
    at = np.searchsorted(_shard(keys, bits), np.arange((1 << bits) + 1)).astype("<u4")
    rest = (keys << np.uint64(bits)) >> np.uint64(64 - REST)
    return {f"{name}_at": at, f"{name}_low": (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), f"{name}_top": (rest >> np.uint64(32)).astype("<u1")}


def _find(arrays: dict[str, np.ndarray], name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of asked, in order, are in a directory, and where those are."""
    at, low, top = arrays[f"{name}_at"], arrays[f"{name}_low"], arrays[f"{name}_top"]
    if not len(low) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = (len(at) - 1).bit_length() - 1
    place = _shard(asked, bits)
    rest = (asked << np.uint64(bits)) >> np.uint64(64 - REST)
    a, b = at[place].astype(np.int64), at[place + 1].astype(np.int64)
    end = b
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        middle = (a + b) >> 1
        safe = np.minimum(middle, len(low) - 1)
        less = ((top[safe].astype(np.uint64) << np.uint64(32)) | low[safe]) < rest
        go = a < b
        a, b = np.where(go & less, middle + 1, a), np.where(go & ~less, middle, b)
    safe = np.minimum(a, len(low) - 1)
    hit = np.nonzero((a < end) & (((top[safe].astype(np.uint64) << np.uint64(32)) | low[safe]) == rest))[0]
    return hit, a[hit]


def _small(name: str, values: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Counts in 4 or 8 bits each; the largest value stands for those in a list of their own."""
    most = (1 << bits) - 1
    large = np.nonzero(values >= most)[0]
    short = np.minimum(values, most).astype("<u1")
    if bits == 4:
        short = np.append(short, np.zeros(len(short) % 2, "<u1"))
        short = short[0::2] | (short[1::2] << 4)
    return {f"{name}_{bits}": short, f"{name}_large": large.astype("<u4"), f"{name}_value": narrow(values[large].astype(np.uint64))}


def _values(arrays: dict[str, np.ndarray], name: str, at: np.ndarray, bits: int) -> np.ndarray:
    """Counts at places, as floats."""
    if bits == 4:
        out = (arrays[f"{name}_4"][at >> 1] >> ((at & 1) * 4).astype(np.uint8)) & 15
    else:
        out = arrays[f"{name}_8"][at]
    large = out == (1 << bits) - 1
    out = out.astype(float)
    out[large] = arrays[f"{name}_value"][np.searchsorted(arrays[f"{name}_large"], at[large])]
    return out


class Shards:
    """The files of one kind, mapped when first used; have: the shards that there are."""

    def __init__(self, folder: str, name: str, bits: int, have: np.ndarray):
        self.folder, self.name, self.bits, self.have, self.open = folder, name, bits, have, {}

    def __getitem__(self, shard: int) -> dict | None:
        if shard not in self.open:
            at = int(np.searchsorted(self.have, shard))
            there = at < len(self.have) and self.have[at] == shard
            # raises if a file of the model isn't to be seen here
            self.open[shard] = _mapped(f"{self.folder}/{self.name}-{shard}.bin") if there else None
        return self.open[shard]

    def find(self, shard: np.ndarray, ask) -> None:
        """Calls ask(arrays, places) for the places in shard of each shard that there is."""
        order = np.argsort(shard, kind="stable")
        at = np.append(_runs(shard[order]), len(order)).tolist()
        for a, b in zip(at, at[1:], strict=False):
            if (arrays := self[int(shard[order[a]])]) is not None:
                ask(arrays, order[a:b])


class Vocabulary:
    """Ids and counts of words by their hashes."""

    def __init__(self, folder: str, bits: int, have: np.ndarray):
        self.bits, self.folder = bits, folder
        self.shards = Shards(folder, "words", bits, have)
        self.base = np.load(f"{folder}/base.npy", mmap_mode="r")  # [shard among have, class]
        self.have = have

    def ids(self, arrays: dict, shard: int, at) -> np.ndarray:
        count = arrays["count"][at]
        power = np.frexp(count.astype(float))[1] - 1
        return (self.base[int(np.searchsorted(self.have, shard))][power] + arrays["rank"][at]).astype(np.uint64)

    def find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Ids and counts of sorted word hashes, and (shard, places in unique, places in the shard)."""
        ids, count, hits = np.full(len(unique), _UNKNOWN, np.uint64), np.zeros(len(unique)), []
        shard = _shard(unique, self.bits)

        def ask(arrays, some):
            at = np.minimum(np.searchsorted(arrays["word"], unique[some]), len(arrays["word"]) - 1)
            hit = arrays["word"][at] == unique[some]
            some, at = some[hit], at[hit]
            if len(some):
                own = int(shard[some[0]])
                ids[some], count[some] = self.ids(arrays, own, at), arrays["count"][at]
                hits.append((own, some, at))

        self.shards.find(shard, ask)
        return ids, count, hits

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """Shards of known words by their ids."""
        order = self.base[:, ::-1].T.ravel()  # in order of ids
        at = np.searchsorted(order, ids.astype(np.int64), "right") - 1
        return self.have[at % len(self.have)]


# counting


def _buffers(batches, most: int):
    """Token hashes and places in their texts, about `most` at once."""
    held, size = [], 0
    for batch in batches:
        column = batch.column("text")
        for at, n in slices(column, WINDOW):
            token, _, place, _ = tokens_of(column.slice(at, n))
            held.append((token, place))
            size += len(token)
            if size >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
                trim()
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _count_words(bits: int):
    def run(batches):
        for token, _ in _buffers(batches, BUFFER):
            word, count = np.unique(token, return_counts=True)
            for row in _dealt(0, _shard(word, bits), [word, count]):
                yield _batch([row])

    return run


def _words_file(folder: str):
    """For applyInArrow: the file of a shard of words, and how many there are of each power of two of their counts."""

    def run(key, table):
        trim()
        parts = [split(x) for x in table["data"].to_pylist()]
        word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        at = _runs(word[order])
        word, count = word[order][at], np.add.reduceat(count[order], at)
        power = np.frexp(count.astype(float))[1] - 1
        rank, by = np.empty(len(word), np.int64), np.argsort(power, kind="stable")
        rank[by] = np.arange(len(word)) - np.searchsorted(power[by], power[by])
        shard = key[0].as_py()
        _write(f"{folder}/words-{shard}.bin", {"word": word, "count": narrow(count), "rank": narrow(rank.astype(np.uint64))})
        figures = {"distinct": len(word), "total": int(count.sum()), "classes": np.bincount(power, minlength=_CLASSES).tolist()}
        return pa.Table.from_batches([_batch([(-1, shard, json.dumps(figures).encode())])])

    return run


def _count(folder: str, order: int, layout: Layout, vocabulary: tuple):
    def run(batches):
        known = Vocabulary(folder, *vocabulary)
        for token, place in _buffers(batches, BUFFER):
            unique, back = np.unique(token, return_inverse=True)
            ids = known.find(unique)[0]
            by = np.argsort(ids)
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(1, len(by) + 1)
            grams = Columns(np.append(_BEGIN, ids[by]), _before(rank[back], place, order))
            del token, back, place
            keys, count = np.unique(grams.keys, return_counts=True)
            columns = grams.columns(keys)
            del grams, keys
            shard = layout.place(columns, _hash(columns[:-1]), layout.parts(columns[:-1]))
            for row in _dealt(order, shard, [*columns, count]):
                yield _batch([row])
            del columns, shard, count
            trim()

    return run


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def _ngrams(folder: str, level: int, layout: Layout, vocabulary: tuple):
    """For applyInArrow: the file of a shard, parts of contexts that are split, and rows of the level below."""

    def run(key, table):
        trim()
        shard = key[0].as_py()
        parts = [split(x) for x in table["data"].to_pylist()]
        *columns, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        grams = _placed(columns)
        del columns
        order = np.argsort(grams.keys, kind="stable")
        keys = grams.keys[order]
        at = _runs(keys)
        keys, count = keys[at], np.add.reduceat(count[order], at).astype(np.int64)
        columns = grams.columns(keys)
        del grams, order
        new = np.zeros(len(keys), bool)
        new[0] = True
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
        first = np.nonzero(new)[0]
        context = [c[first] for c in columns[:-1]]
        total = np.add.reduceat(count, first)
        one, two = (np.add.reduceat((count == c).astype(np.int64), first) for c in (1, 2))
        more = np.diff(np.append(first, len(keys))) - one - two
        hashed = _hash(columns)
        by = np.argsort(hashed)
        arrays = _directory("gram", hashed[by]) | _small("count", count[by], 4)
        of_context, hot = _hash(context), layout.parts(context) > 1
        by = np.argsort(mix(of_context))
        for name, some in (("once", by[(total[by] == 1) & ~hot[by]]), ("context", by[(total[by] > 1) & ~hot[by]])):
            arrays |= _directory(name, mix(of_context[some]))
            if name == "context":
                for x, values in (("total", total), ("n1", one), ("n2", two), ("n3", more)):
                    arrays |= _small(x, values[some], 8)
        _write(f"{folder}/{level}-{shard}.bin", arrays)
        del arrays, hashed, by
        rows = [(-level, shard, json.dumps({"n": _counts_of_counts(count)}).encode())]
        if hot.any():
            order = np.nonzero(hot)[0][np.argsort(of_context[hot])]
            rows += _dealt(_HOT + level, _shard(of_context[order], layout.bits), [of_context[order], *(x[order] for x in (total, one, two, more))])
        below = _placed(columns[1:])
        del columns
        keys, count = np.unique(below.keys, return_counts=True)
        columns = below.columns(keys)
        del below, keys
        if level > 2:
            to = layout.place(columns, _hash(columns[:-1]), layout.parts(columns[:-1]))
        else:
            to = Vocabulary(folder, *vocabulary).shard_of(columns[0])
        rows += _dealt(level - 1, to, [*columns, count])
        return pa.Table.from_batches([_batch(rows)])

    return run


def _last(folder: str, vocabulary: tuple):
    """For applyInArrow: the files of continuation counts and of contexts that were split, and their figures."""

    def run(key, table):
        trim()
        level, shard = key[0].as_py(), key[1].as_py()
        first, *values = (np.concatenate(x) for x in zip(*(split(x) for x in table["data"].to_pylist()), strict=True))
        order = np.argsort(first, kind="stable")
        at = _runs(first[order])
        first, values = first[order][at], [np.add.reduceat(x[order], at) for x in values]
        if level > _HOT:
            _write(f"{folder}/hot{level - _HOT}-{shard}.bin", {"context": first} | {n: x.astype("<u8") for n, x in zip(("total", "n1", "n2", "n3"), values, strict=True)})
            return pa.Table.from_batches([_batch([(-level, shard, b"{}")])])
        known = Vocabulary(folder, *vocabulary)
        arrays = known.shards[shard]
        ids = known.ids(arrays, shard, slice(None))
        by = np.argsort(ids)
        follows = np.zeros(len(ids), np.uint64)
        follows[by[np.searchsorted(ids[by], first)]] = values[0]
        _write(f"{folder}/follows-{shard}.bin", _small("follows", follows, 8))
        figures = {"n": _counts_of_counts(values[0]), "follows": int(values[0].sum()), "kinds": len(first)}
        return pa.Table.from_batches([_batch([(-1, shard, json.dumps(figures).encode())])])

    return run


# the model


def discounts(n: list[int]) -> list[float]:
    """0, D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    if not all(n[:3]):
        return [0.0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3))]


class Model:
    """What a worker needs to score: the folder, where n-grams lie, which shards there are, and a few figures."""

    def __init__(self, folder: str, order: int, layout: Layout, vocabulary: tuple, have: dict[str, np.ndarray], figures: dict):
        self.args = (folder, order, layout, vocabulary, have, figures)
        self.folder, self.order, self.layout, self.figures, self.bits = folder, order, layout, figures, layout.bits
        shards = lambda name, bits: Shards(folder, name, bits, have.get(name, np.zeros(0, np.int64)))
        self.levels = {n: shards(str(n), layout.bits) for n in range(2, order + 1)}
        self.hot = {n: shards(f"hot{n}", layout.bits) for n in range(2, order + 1)}
        self.follows = shards("follows", vocabulary[0])
        self._vocabulary, self._known = vocabulary, None

    @property
    def train_tokens(self) -> int:
        return self.figures["total"]

    @property
    def vocabulary(self) -> int:
        return self.figures["distinct"]

    def probabilities(self, token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p of each token after its context, and its plain count."""
        unique, back = np.unique(token, return_inverse=True)
        f = self.figures
        if not f["total"]:
            return np.ones(len(token)), np.zeros(len(token))
        self._known = self._known or Vocabulary(self.folder, *self._vocabulary)
        ids, count, hits = self._known.find(unique)
        follows = np.zeros(len(unique))
        for shard, some, at in hits:
            follows[some] = _values(self.follows[shard], "follows", at, 8)
        d = np.array(f["discounts"]["1"])
        kept = np.maximum(follows - d[np.minimum(follows, 3).astype(np.int64)], 0) / f["follows"]
        n1, n2 = f["n"][:2]
        p = kept + (d[1] * n1 + d[2] * n2 + d[3] * (f["kinds"] - n1 - n2)) / f["follows"] / (f["distinct"] + 1)
        distinct, of = np.unique(ids, return_inverse=True)  # all unknown words are one
        local = (of + 1)[back]
        distinct = np.append(_BEGIN, distinct)
        p = p[back]
        for level in range(2, self.order + 1):
            p = self._interpolated(level, Columns(distinct, _before(local, place, level)), p)
        return p, count[back]

    def _interpolated(self, level: int, grams: Columns, below: np.ndarray) -> np.ndarray:
        d = np.array(self.figures["discounts"][str(level)])
        keys, back = np.unique(grams.keys, return_inverse=True)
        columns = grams.columns(keys)
        new = np.zeros(len(keys), bool)
        new[:1] = True
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
        first = np.nonzero(new)[0]
        of = np.cumsum(new) - 1
        context = [c[first] for c in columns[:-1]]
        hashed, parts = _hash(context), self.layout.parts(context)
        total, gamma = np.ones(len(first)), np.ones(len(first))

        def ask_context(x, some):
            asked = mix(hashed[some])
            by = np.argsort(asked)
            asked, some = asked[by], some[by]
            gamma[some[_find(x, "once", asked)[0]]] = d[1]
            hit, at = _find(x, "context", asked)
            some = some[hit]
            total[some] = _values(x, "total", at, 8)
            gamma[some] = (d[1] * _values(x, "n1", at, 8) + d[2] * _values(x, "n2", at, 8) + d[3] * _values(x, "n3", at, 8)) / total[some]

        def ask_hot(x, some):
            at = np.minimum(np.searchsorted(x["context"], hashed[some]), len(x["context"]) - 1)
            hit = x["context"][at] == hashed[some]
            some, at = some[hit], at[hit]
            total[some] = x["total"][at]
            gamma[some] = (d[1] * x["n1"][at] + d[2] * x["n2"][at] + d[3] * x["n3"][at]) / total[some]

        shards, plain = self.levels[level], np.nonzero(parts == 1)[0]
        own = _shard(hashed, self.bits)
        shards.find(own[plain], lambda x, some: ask_context(x, plain[some]))
        split_ = np.nonzero(parts > 1)[0]
        self.hot[level].find(own[split_], lambda x, some: ask_hot(x, split_[some]))
        found, whole = np.zeros(len(keys)), _hash(columns)

        def ask(x, some):
            some = some[np.argsort(whole[some])]
            hit, at = _find(x, "gram", whole[some])
            c = _values(x, "count", at, 4)
            found[some[hit]] = c - d[np.minimum(c, 3).astype(np.int64)]

        shards.find(self.layout.place(columns, hashed[of], parts[of]), ask)
        return (found / total[of])[back] + gamma[of][back] * below

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score, score of every row of a string array."""
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for at, n in slices(column, 4 * WINDOW):  # what is looked up in each shard follows the window
            token, _, place, first = tokens_of(column.slice(at, n))
            p, count = self.probabilities(token, place)
            base = np.log10((count + 0.1) / (self.train_tokens + 0.1 * (self.vocabulary + 1)))
            for name, x in (("n_known", count > 0), ("base_score", base), ("score", np.log10(p))):
                out[name].append(np.add.reduceat(x.astype(np.int64 if name == "n_known" else float), first[:-1]))
            out["n_tokens"].append(np.diff(first))
        return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}


def _mounted(folder: str) -> str:
    scheme, _, path = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"the model's folder has to be a path that workers can map, not {folder}; mount it or give another")
    return "/" + path.lstrip("/")


def _figures(rows: DataFrame) -> dict[int, tuple[np.ndarray, list[dict]]]:
    """level -> shards in order, and their figures."""
    out: dict[int, list] = {}
    for r in rows.where("level < 0").collect():
        out.setdefault(-r["level"], []).append((r["shard"], json.loads(bytes(r["data"]))))
    return {level: (np.array([s for s, _ in sorted(own, key=lambda x: x[0])], np.int64), [x for _, x in sorted(own, key=lambda x: x[0])]) for level, own in out.items()}


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> Model:
    """Counts docs (all of them) and leaves the model's files in folder."""
    if order < 2:
        raise ValueError("order has to be 2 or more")
    spark = docs.sparkSession
    folder = _mounted(folder or new_folder(spark, "ngrams"))
    rows = texts(docs).select("text")
    size, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = max(0, math.ceil(math.log2(max(1, ((size or 0) / 6 + n_rows) / SHARD_PAIRS))))
    if not n_rows:
        return Model(folder, order, Layout(0, 1, [1] * _CLASSES, 0), (0, np.zeros(0, np.int64)), {}, {"total": 0, "distinct": 0})
    # the vocabulary
    word_bits = max(0, bits - 3)
    counted = stored(rows.mapInArrow(_count_words(word_bits), ROWS).groupBy("shard").applyInArrow(_words_file(folder), ROWS), "words")
    have, found = _figures(counted)[1]
    drop(spark, counted)
    classes = np.array([x["classes"] for x in found], np.int64)  # [shard, class]
    flat = classes[:, ::-1].T.ravel()
    base = (1 + np.cumsum(flat) - flat).reshape(_CLASSES, len(have)).T[:, ::-1]
    os.makedirs(folder, exist_ok=True)
    np.save(f"{folder}/base.npy", np.ascontiguousarray(base))
    starts = base[0][::-1].tolist() if len(have) else []  # first ids of the classes, the most frequent one first
    layout = Layout(bits, SHARD_PAIRS // HOT_PARTS, starts, n_rows)
    vocabulary = (word_bits, have)
    # n-grams, level by level
    own = rows.mapInArrow(_count(folder, order, layout, vocabulary), ROWS)
    files, figures, steps = {}, {"total": sum(x["total"] for x in found), "distinct": sum(x["distinct"] for x in found), "discounts": {}}, []
    for level in range(order, 1, -1):
        made = stored(own.groupBy("shard").applyInArrow(_ngrams(folder, level, layout, vocabulary), ROWS), f"ngrams{level}")
        files[str(level)], got = _figures(made)[level]
        figures["discounts"][str(level)] = discounts([sum(x["n"][i] for x in got) for i in range(4)])
        steps.append(made)
        own = made.where(F.col("level") == level - 1)
    hot = [made.where(F.col("level") > _HOT) for made in steps]
    for more in hot:
        own = own.unionByName(more)
    made = stored(own.groupBy("level", "shard").applyInArrow(_last(folder, vocabulary), ROWS), "follows")
    for level, (shards, got) in _figures(made).items():
        if level > _HOT:
            files[f"hot{level - _HOT}"] = shards
        else:
            files["follows"] = shards
            figures |= {name: sum(x[name] for x in got) for name in ("follows", "kinds")}
            figures["n"] = [sum(x["n"][i] for x in got) for i in range(4)]
            figures["discounts"]["1"] = discounts(figures["n"])
    for used in (*steps, made):
        drop(spark, used)
    return Model(folder, order, layout, vocabulary, files, figures)


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    args = model.args

    def run(batches):
        own = Model(*args)
        for batch in batches:
            got = own.score(batch.column("text"))
            n = batch.num_rows
            trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(np.full(n, own.train_tokens, np.int64)), pa.array(got["base_score"], pa.float64()), pa.array(got["score"], pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts(docs).withColumn("held_out", held_out).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 10, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs.where(~held_out())), held_out())


QUERIES = {"op1_ngram_lm": _query}
ORACLE_SQL: dict[str, str] = {}
