"""Exact n-gram Jaccard self-join by parity sketches.

A document's set holds its distinct shingles, as 64-bit hashes. Two sets with Jaccard similarity of at
least p / q have a symmetric difference of at most (|A| + |B|) (q - p) / (q + p). A parity sketch flips a
bit for every member, so equal members cancel out and the Hamming distance of two sketches never exceeds
the symmetric difference.

Size bands: sizes in one band differ by less than a factor of p / q, so links stay in a band or join
neighbouring ones; each set takes part in its own band's join and in the next one's. A join with the
largest difference d cuts the sketch into n > d blocks, of which n - d at least are equal for a link. A
block's bits are as many as there are hashes, few of them set; what stands for it is the xor of the
numbers of its set bits, so it's had by xoring the members' hashes into the block. Blocks are ordered by
the number of members, fullest first, then by value; by the prefix principle a link shares one of the
first d + 1 of them, and those, the ones that say most, are what is joined.

Join: a task collapses each signature that several of its sets have to one of them and links the others
to it; only that one is shuffled, so a group of copies costs a row per task and signature. What meets in
the shuffle is linked to one of its sets in turn. These stars, a row per set and signature, are verified
by wide sketches, then on the shingles themselves, and give first components. Of signatures with the same
sets one is gone through, in tiles of bounded size: every pair of its sets that has no smaller such signature
in common, and that the wide sketches leave a chance, is compared on the shingles. So each link is verified
once. A tile adds up every set's links, and lists a link only where it joins two components, so the links
of every document are counted and the pairs of a component are never listed.

Sets are known by a 64-bit digest, which copies share: what is shuffled is sets, not documents. A second
64-bit digest goes with every document; sets that have the first in common but not the second are found
before anything is joined, and the join begins again with the second one standing for those. Shingles are
64-bit hashes, compared within a pair of sets only.

Defined results: null texts count as empty; texts without words have an empty set and link with nothing;
texts with fewer words than a shingle have the whole sequence as their one shingle; copies are linked;
repeated rows repeat; rows with a null id take part, and a component of such rows alone has a null id; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipquarry.llm.common import drop, few, fresh, held, stored, table, texts, trim
from ipquarry.llm.components import components
from ipquarry.llm.planes import pack as _pack
from ipquarry.llm.planes import unpack as _unpack
from ipquarry.llm.wordhash import WINDOW, buffer, mix, slices, words

WORDS, SIMILARITY = 5, (80, 100)
#: Blocks beyond d + 1, as a share, among which the fullest are chosen.
SPARE = 0.25
#: Signatures that a task holds before it sends them on, and bytes of text for each bucket of them.
HELD = 1_000_000
BUCKET_BYTES = 24 << 20
#: Sets of one side of a tile, and bytes of their members, at most.
TILE, TILE_BYTES = 4096, 16 << 20
LEAST_BITS = 256
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows, one after the other, and the bounds of each row's."""
    hashes, _, upto = words(*buffer(column))
    per = np.diff(upto)
    row = np.repeat(np.arange(len(per)), per)
    left = upto[1:][row] - np.arange(len(hashes))  # words from here to the row's end
    h = mix(hashes + np.uint64(1))
    for j in range(1, k):
        at = np.nonzero(left > j)[0]
        h[at] = mix(h[at] ^ mix(hashes[at + j] + np.uint64(j + 1)))
    short = per[row] < k
    whole = short & (left == per[row])
    h[whole] = mix(h[whole] ^ (_SHORT * per[row][whole].astype(np.uint64)))
    use = (left >= k) | whole
    h, row = h[use], row[use]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(per) + 1))


def digests(h: np.ndarray, bounds: np.ndarray, moved: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set, as signed integers.

    Where the first, of which so many bits are used, is among the sorted ones in moved, it's the second too.
    """

    def of(salt: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(np.diff(bounds).astype(np.uint64)))

    first, second = (of(0x2545F4914F6CDD1D) >> np.uint64(64 - bits)).view(np.int64), of(0x6A09E667F3BCC909).view(np.int64)
    if moved is not None and len(moved):
        first = np.where(np.isin(first, moved), second, first)
    return first, second


@functools.lru_cache(8)
def bands(similarity: tuple[int, int], upto: int) -> np.ndarray:
    """First sizes of the bands, past upto by two bands at least."""
    p, q = similarity
    out = [1]
    while len(out) < 4 or out[-3] <= upto:
        out.append(max(out[-1] + 1, out[-1] * q // p + 1))
    return np.array(out, np.int64)


def most_difference(total, similarity: tuple[int, int]):
    """Largest symmetric difference of linked sets whose sizes add up to total."""
    p, q = similarity
    return total * (q - p) // (q + p)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def signatures(h: np.ndarray, bounds: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, whether the join is of the row's own band) for rows of sets; empty ones have none."""
    size = np.diff(bounds)
    edges = bands(similarity, int(size.max(initial=1)))
    band = np.searchsorted(edges, size, "right") - 1
    out = []
    row = np.repeat(np.arange(len(size)), size)
    place = mix(h ^ np.uint64(0x9E6C63D0876A9A35))
    for own in (True, False):
        join = band + (not own)
        d = most_difference(2 * (edges[join + 1] - 1), similarity)
        n = np.where(d > 0, d + 1 + np.ceil(SPARE * (d + 1)).astype(np.int64), 1)
        n[size == 0] = 0
        first = np.concatenate([[0], np.cumsum(n)])
        block = ((place >> np.uint64(32)) * n[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        bits, full = np.zeros(int(first[-1]), np.uint64), np.bincount(first[row] + block, minlength=int(first[-1]))
        np.bitwise_xor.at(bits, first[row] + block, place)
        owner = np.repeat(np.arange(len(size)), n)
        number = np.arange(len(bits)) - first[owner]
        value = mix(mix(bits) ^ mix((join[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
        order = np.lexsort((value, -full, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[owner[order]]
        keep = rank <= d[owner]
        out.append((value[keep], owner[keep], np.full(int(keep.sum()), own)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# signatures that meet

KINDS = "kind int, bucket int, doc_id long, key long, node long, second long, n long, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((name, pa.int64()) for name in ("doc_id", "key", "node", "second", "n")), ("data", pa.binary())])
_DOCUMENT, _SIGNATURES, _STARS = 0, 1, 2
_PAIRS = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def stars(sig: np.ndarray, node: np.ndarray, own: np.ndarray):
    """Sorted by signature: one set of each, of the join's own band if any is; and (sig, that one, other)."""
    order = np.lexsort((node, ~own, sig))
    sig, node, own = sig[order], node[order], own[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    at = np.nonzero(new)[0]
    centre = np.repeat(node[at], np.diff(np.append(at, len(sig))))
    other = ~new & (node != centre)
    return (sig[at], node[at], own[at]), (sig[other], centre[other], node[other])


def _held(sig, node, own) -> bytes:
    nodes, at = np.unique(node, return_inverse=True)
    parts = [_pack(sig), _pack(nodes), _pack((at * 2 + own).astype("<u4"))]
    return struct.pack("<QQ", len(sig), len(nodes)) + b"".join(struct.pack("<Q", len(x)) + x for x in parts)


def _read(data: bytes):
    n, m = struct.unpack_from("<QQ", data)
    at, parts = 16, []
    for _ in range(3):
        size = struct.unpack_from("<Q", data, at)[0]
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    which = _unpack(parts[2], "<u4", n).astype(np.int64)
    return _unpack(parts[0], "<u8", n), _unpack(parts[1], "<i8", m)[which >> 1], (which & 1).astype(bool)


def _rows(kind: int, bucket, data) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(5)), pa.array(data, pa.binary())], schema=_SCHEMA)


def _emit(k: int, similarity: tuple[int, int], buckets: int, moved: np.ndarray, bits: int):
    def flush(held):
        sig, node, own = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        (sig, node, own), pairs = stars(sig, node, own)
        for kind, key, columns in ((_SIGNATURES, sig, (sig, node, own)), (_STARS, pairs[0], pairs)):
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # sorted, as the keys are
            for b in np.unique(bucket).tolist():
                x, y = np.searchsorted(bucket, [b, b + 1])
                part = [c[x:y] for c in columns]
                yield _rows(kind, [b], [_held(*part) if kind == _SIGNATURES else _pack(np.stack([c.astype(np.uint64) if c.dtype == np.uint64 else c.view(np.uint64) for c in part], 1).ravel())])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            column = batch.column("text")
            for at, n in slices(column, WINDOW):
                h, bounds = shingles(column.slice(at, n), k)
                (node, second), count = digests(h, bounds, moved, bits), np.diff(bounds)
                wide, at_ = sketches(h, bounds)
                columns = [batch.column("doc_id").slice(at, n), batch.column("key").slice(at, n), pa.array(node, mask=count == 0), pa.array(second), pa.array(count), pa.array([wide[a:b].tobytes() for a, b in zip(at_, at_[1:], strict=False)], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([_DOCUMENT] * n, pa.int32()), pa.array([-1] * n, pa.int32()), *columns], schema=_SCHEMA)
                fresh = [i for i, (x, c) in enumerate(zip(node.tolist(), count.tolist(), strict=True)) if c and not (x in seen or seen.add(x))]
                if not fresh:
                    continue
                part = np.zeros(n, bool)
                part[fresh] = True
                h = h[np.repeat(part, count)]
                bounds = np.concatenate([[0], np.cumsum(count[part])])
                sig, row, own = signatures(h, bounds, similarity)
                held.append((sig, node[part][row], own))
                size += len(sig)
                if size >= HELD:
                    yield from flush(held)
                    size, seen = 0, set()
                    trim()
        if size:
            yield from flush(held)

    return run


def _meet(key, table):
    """For applyInArrow: the stars of a bucket of signatures."""
    trim()
    held, pairs = [], []
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        if kind == _SIGNATURES:
            held.append(_read(data))
        else:
            import zstandard

            n = len(zstandard.ZstdDecompressor().decompress(data)) // 8
            pairs.append(_unpack(data, "<u8", n).reshape(-1, 3).T)
    found = [p for p in pairs]
    if held:
        sig, node, own = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        many = np.zeros(len(sig), bool)  # signatures that are met again: few
        many[order[1:][same]] = many[order[:-1][same]] = True
        (_, centre, centre_own), met = stars(sig[many], node[many], own[many])
        found.append(np.stack([met[0], met[1].view(np.uint64), met[2].view(np.uint64)]))
    sig, a, b = (np.concatenate(x).view(np.int64) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    return pa.Table.from_arrays([pa.array(sig), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIRS)


# verification


def _sets(k: int, moved: np.ndarray, bits: int):
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for at, n in slices(column, WINDOW):
                h, bounds = shingles(column.slice(at, n), k)
                yield pa.RecordBatch.from_arrays([pa.array(digests(h, bounds, moved, bits)[0]), pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["node", "members"])

    return run


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets link."""
    p, q = similarity
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def _verified(similarity: tuple[int, int]):
    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = [linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), similarity) for s, t in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketches(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wide parity sketches of the rows' sets, one after the other, and their bounds in words.

    A sketch has at least twice as many bits as the set has members, a power of two; xor of its halves is
    the sketch of half the width, so any two can be compared.
    """
    size = np.diff(bounds)
    bits = np.maximum(LEAST_BITS, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits // 64)])
    row = np.repeat(np.arange(len(size)), size)
    at = (mix(h ^ np.uint64(0x71D67FFFEDA60000)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(first[-1]), np.uint64)
    np.bitwise_xor.at(out, first[row] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out, first


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches [rows, words] at a smaller width."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def possible(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets of n and m members, with sketches x and y, may link."""
    p, q = similarity
    out = q * np.minimum(n, m) >= p * np.maximum(n, m)
    left, right = (np.fromiter(map(len, v), np.int64, len(v)) // 8 for v in (x, y))
    shape = np.where(out, left * (1 << 32) + right, -1)
    for one in np.unique(shape[out]).tolist():
        at = np.nonzero(shape == one)[0]
        a, b = one >> 32, one & 0xFFFFFFFF
        width = min(a, b)
        per = max(1, (1 << 21) // max(a, b))  # bounds what is compared at once
        for part in (at[i : i + per] for i in range(0, len(at), per)):
            s = folded(np.frombuffer(b"".join(x[i] for i in part), np.uint64).reshape(-1, a), width)
            t = folded(np.frombuffer(b"".join(y[i] for i in part), np.uint64).reshape(-1, b), width)
            out[part] = _popcount(s ^ t).sum(1) <= most_difference(n[part] + m[part], similarity)
    return out


def _near(similarity: tuple[int, int]):
    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            keep = possible(batch.column("x").to_pylist(), batch.column("y").to_pylist(), n, m, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


TILES = "sig long, i int, j int, tile int, node long"


def _groups(batches, names: list[str]):
    """Columns of each (sig, i, j) of rows sorted by them; of a tile, which is what is held, 2 * TILE rows at most."""
    at, held = None, []

    def whole():
        return [np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for part in x for v in part] for x in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("sig", "i", "j")]
        columns = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in (batch.column(n) for n in names)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        cut = np.append(np.nonzero(new)[0], batch.num_rows)
        for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            key = tuple(int(k[x]) for k in keys)
            if key != at:
                if held:
                    yield at, whole()
                at, held = key, []
            held.append([c[x:y] for c in columns])
    if held:
        yield at, whole()


class _Tile:
    """The rows of a tile, with sketches of one width; signatures are the sorted ones that are gone through."""

    def __init__(self, key, tile, node, n, signatures, sketch, similarity):
        self.node, self.n, self.similarity = node, n, similarity
        self.left, self.right = np.nonzero(tile == key[1])[0], np.nonzero(tile == key[2])[0]
        self.inner = key[1] == key[2]
        width = min(map(len, sketch)) // 8
        wide: dict[int, list[int]] = {}
        for r, x in enumerate(sketch):
            wide.setdefault(len(x) // 8, []).append(r)
        self.flat = np.empty((len(sketch), width), np.uint64)
        for size, rows in wide.items():
            self.flat[rows] = folded(np.frombuffer(b"".join(sketch[r] for r in rows), np.uint64).reshape(-1, size), width)
        # signatures before this one that rows share: of each row, and the rows of each
        sig, row = np.concatenate(signatures), np.repeat(np.arange(len(node)), [len(x) for x in signatures])
        sig, row = sig[sig < key[0]], row[sig < key[0]]
        _, which, count = np.unique(sig, return_inverse=True, return_counts=True)
        many = count[which] > 1
        which, row = which[many], row[many]
        self.before, self.before_at = which, np.searchsorted(row, np.arange(len(node) + 1))
        order = np.argsort(which, kind="stable")
        self.having, self.having_at = row[order], np.searchsorted(which[order], np.arange(len(count) + 1))

    def near(self, x: int) -> np.ndarray:
        """Rows that the sketches and sizes don't rule out for a row of the left side; of pairs that no signature before has."""
        p, q = self.similarity
        met = np.zeros(len(self.node), bool)
        for s in self.before[self.before_at[x] : self.before_at[x + 1]].tolist():
            met[self.having[self.having_at[s] : self.having_at[s + 1]]] = True
        y = self.right[~met[self.right]]
        if self.inner:
            y = y[self.node[y] > self.node[x]]
        y = y[q * np.minimum(self.n[y], self.n[x]) >= p * np.maximum(self.n[y], self.n[x])]
        per = max(1, (1 << 21) // self.flat.shape[1])
        parts = [y[k : k + per] for k in range(0, len(y), per)]
        parts = [part[_popcount(self.flat[part] ^ self.flat[x]).sum(1) <= most_difference(self.n[part] + self.n[x], self.similarity)] for part in parts]
        return np.concatenate(parts) if parts else y


class _Sets:
    """Sets by dense numbers of their members, so that one is compared with many at once."""

    def __init__(self, sets: list[np.ndarray], similarity: tuple[int, int]):
        self.n, self.similarity = np.array([len(x) for x in sets]), similarity
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
        self.number, self.flag = number.astype(np.int32), np.zeros(len(distinct), bool)

    def linked(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of y that link with x."""
        p, q = self.similarity
        own = self.number[self.at[x] : self.at[x + 1]]
        self.flag[own] = True
        part = np.cumsum(self.n[y]) >> 21  # bounds what is compared at once
        out = []
        for some in np.split(y, np.nonzero(np.diff(part))[0] + 1):
            n = self.n[some]
            first = np.cumsum(n) - n
            place = np.repeat(self.at[some] - first, n) + np.arange(int(n.sum()))
            both = np.add.reduceat(self.flag[self.number[place]].astype(np.int64), first)
            out.append(some[q * both >= p * (n + len(own) - both)])
        self.flag[own] = False
        return np.concatenate(out)


def _candidates(similarity: tuple[int, int], counted: bool):
    """For mapInArrow over sorted tiles: their rows that may link with another."""

    def run(batches):
        for key, (tile, node, n, root, signatures, sketch) in _groups(batches, ["tile", "node", "n", "root", "signatures", "sketch"]):
            rows = _Tile(key, tile, node, n, signatures, sketch, similarity)
            some = np.zeros(len(node), bool)
            for x in rows.left.tolist():
                near = rows.near(x)
                if not counted:
                    near = near[root[near] != root[x]]
                if len(near):
                    some[x] = some[near] = True
            if size := int(some.sum()):
                yield pa.RecordBatch.from_arrays([pa.array([k] * size, t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)] + [pa.array(c[some]) for c in (tile, node)], ["sig", "i", "j", "tile", "node"])

    return run


def _counting(similarity: tuple[int, int], counted: bool):
    """For mapInArrow over sorted tiles with members: every pair is verified, or, without counted, of every two roots.

    Rows (a, null, n) are a set's number of linked documents in the tile, rows (a, b, null) links, one at
    most for each component that they join.
    """

    def run(batches):
        for key, (tile, node, copies, root, signatures, members) in _groups(batches, ["tile", "node", "copies", "root", "signatures", "members"]):
            sets = [np.frombuffer(x, np.uint64) for x in members]
            n = np.array([len(x) for x in sets])
            wide, at = sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
            rows = _Tile(key, tile, node, n, signatures, [wide[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], similarity)
            exact, root, count = _Sets(sets, similarity), root.copy(), np.zeros(len(node), np.int64)
            a, b = [], []
            for x in rows.left.tolist():
                y = rows.near(x)
                if not counted:
                    y = y[root[y] != root[x]]
                if not len(y):
                    continue
                y = exact.linked(x, y)
                count[x] += copies[y].sum()
                count[y] += copies[x]
                for z in y[root[y] != root[x]].tolist():
                    if root[z] != root[x]:
                        root[root == root[z]] = root[x]
                        a.append(min(node[x], node[z]))
                        b.append(max(node[x], node[z]))
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], np.array(a, np.int64)])), pa.array([None] * int(some.sum()) + b, pa.int64()), pa.array(count[some].tolist() + [None] * len(a), pa.int64())], ["a", "b", "n"])

    return run


def _both(pairs: DataFrame, sets: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
    """pairs with columns of both their sets: (of the set, as of a, as of b)."""
    of = lambda side, k: sets.select(F.col("node").alias(side), *(F.col(c[0]).alias(c[k]) for c in columns))
    return pairs.join(of("b", 2), "b").join(of("a", 1), "a").select("a", "b", *(c[k] for c in columns for k in (1, 2)))


def _members(rows: DataFrame, documents: DataFrame, nodes: DataFrame, sets_of) -> DataFrame:
    """(node, members) of nodes, from the text of one document each."""
    wanted = documents.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"))
    wanted = held(wanted.select("id").distinct())
    again = rows.join(few(wanted), rows.doc_id.eqNullSafe(wanted.id), "left_semi")
    sets = again.select("text").mapInArrow(sets_of, "node long, members binary").join(nodes, "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.first("members").alias("members")), "sets")
    wanted.unpersist()
    return sets


def _emitted(rows: DataFrame, k: int, similarity: tuple[int, int], buckets: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(signatures and stars; documents; sketches; first digests that second ones stand for)."""
    spark, moved = rows.sparkSession, np.zeros(0, np.int64)
    while True:
        emitted = stored(rows.mapInArrow(_emit(k, similarity, buckets, moved, bits), KINDS), "signatures")
        of_documents = emitted.where(f"kind = {_DOCUMENT}")
        sketched = of_documents.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("sketch"), F.count("*").alias("copies"), (F.min("second") != F.max("second")).alias("clash"))
        sketched = stored(sketched, "sketches")
        # of N sets some N ** 2 / 2 ** 65
        clashes = np.array([r["node"] for r in sketched.where("clash").select("node").collect()], np.int64)
        if not len(clashes):
            return emitted, stored(of_documents.select("doc_id", "key", "node", "n"), "sets_of_documents"), sketched, moved
        if np.isin(clashes, moved).all():
            raise ValueError("sets that differ have both digests in common")
        moved = np.union1d(moved, clashes)
        drop(spark, emitted)
        drop(spark, sketched)


def join(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, digest_bits: int = 64, counted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(documents: doc_id, key, node, n; links: a, b of verified sets, enough for every component; roots: node, root;
    counts: node, n_links: how many documents of other sets link with it, over all pairs; none is without a row).

    key is a hash of the text, by which rows that repeat an id are told apart. Without counted, counts is None, and
    pairs of sets that are in one component already, whose links change nothing but counts, aren't compared.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("key", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    emitted, documents, sketched, moved = _emitted(rows, k, similarity, buckets, digest_bits)
    sets_of = _sets(k, moved, digest_bits)
    met = stored(emitted.where(f"kind <> {_DOCUMENT}").select("kind", "bucket", "data").groupBy("bucket").applyInArrow(_meet, "sig long, a long, b long"), "stars")
    drop(spark, emitted)
    near = _both(met.select("a", "b").distinct(), sketched, ("n", "n", "m"), ("sketch", "x", "y")).mapInArrow(_near(similarity), "a long, b long")
    near = held(near)
    sets = _members(rows, documents, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), sets_of)
    links = stored(_both(near, sets, ("members", "x", "y")).mapInArrow(_verified(similarity), "a long, b long"), "links")
    drop(spark, sets)
    verified, roots = links, stored(components(links), "roots")

    # every other pair of a signature's sets; of signatures with the same sets one is enough
    members = met.select("sig", F.explode(F.array("a", "b")).alias("node")).distinct().join(sketched.select("node", "n"), "node")
    if not counted:
        members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(members, "members")
    one = F.lit(False) if counted else F.min("root") == F.max("root")
    shared = members.groupBy("sig").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("print"), F.min("node").alias("a"), F.max("node").alias("b"), one.alias("one"))
    shared = stored(shared.where("not one").groupBy("m", "n", "print").agg(F.min("sig").alias("sig"), F.first("a").alias("a"), F.first("b").alias("b")), "shared")
    open_ = shared.where("m > 2").select("sig", F.ceil(F.greatest(F.col("m") / TILE, F.col("m") * F.col("n") * 8 / TILE_BYTES)).cast("int").alias("tiles"))
    opened = stored(members.select("sig", "node", "n").join(open_, "sig"), "opened")
    # by its signatures a pair is counted once; where links aren't counted, rows go without them
    of_sets = opened.groupBy("node").agg((F.sort_array(F.collect_list("sig")) if counted else F.max(F.array().cast("array<long>"))).alias("signatures"))
    of_sets = of_sets.join(sketched, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_sets = stored(of_sets, "open_sets")
    tiled = opened.select("sig", "node", "tiles").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.join(of_sets.select("node", "n", "root", "signatures", "sketch"), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("sig", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "n", "root", "signatures", "sketch")
    tiled = tiled.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_candidates(similarity, counted), TILES)
    tiled = held(tiled)
    more = None
    if not tiled.isEmpty():
        sets = _members(rows, documents, tiled.select("node").distinct(), sets_of)
        again = tiled.join(of_sets.select("node", "copies", "root", "signatures"), "node").join(sets, "node")
        again = again.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        more = stored(again.select("sig", "i", "j", "tile", "node", "copies", "root", "signatures", "members").mapInArrow(_counting(similarity, counted), "a long, b long, n long"), "more_links")
        drop(spark, sets)
        joining = more.where("b is not null").select("a", "b")
        if not joining.isEmpty():
            links = stored(links.union(joining), "links")
            roots = stored(components(links), "roots")
    counts = None
    if counted:
        # with two sets, their pair has been looked at; it counts where no signature with more sets has both
        two = shared.where("m = 2").select("a", "b").join(verified, ["a", "b"], "left_semi")
        listed = lambda side: of_sets.select(F.col("node").alias(side), F.col("signatures").alias(f"of_{side}"))
        two = two.join(listed("a"), "a", "left").join(listed("b"), "b", "left").where(~F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False)))
        ends = two.select("a", "b").union(two.select("b", "a")).toDF("node", "other")
        counts = ends.join(sketched.select(F.col("node").alias("other"), F.col("copies").alias("n")), "other").select("node", "n")
        if more is not None:
            counts = counts.union(more.where("b is null").select(F.col("a").alias("node"), "n"))
        counts = stored(counts.groupBy("node").agg(F.sum("n").alias("n_links")), "link_counts")
    for used in (met, members, sketched, shared, opened, of_sets):
        drop(spark, used)
    for used in (near, tiled):
        used.unpersist()
    return documents, links, roots, counts


def near_duplicates(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, digest_bits: int = 64) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, n_links: how many other documents it links with."""
    documents, _, roots, counts = join(docs, k, similarity, digest_bits)
    per_set = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = per_set.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = per_set.select("node", "root", "copies").join(ids, "root").join(counts, "node", "left")
    ids = ids.select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Sets of one document only need no join; adaptive execution may split the partition of a hot one.
    out = documents.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, and all without words.

    It's the row with the smallest id; a null id comes after all others, and of equal ids the text decides.
    """
    documents, _, roots, _ = join(docs, k, similarity, counted=False)
    rooted = documents.where("node is not null").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    groups = rooted.groupBy("root").agg(first, F.count("*").alias("rows")).where("rows > 1")
    judged = rooted.join(groups, "root").groupBy("doc_id", "key").agg(F.any_value(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))).alias("kept"), F.count("*").alias("times"))
    own, other, key = fresh(docs, "text_key"), fresh(docs, "other_id"), fresh(docs, "other_key")
    odd = stored(judged.where("not kept or times > 1"), "judged")
    gone, again = (odd.where(test).select(F.col("doc_id").alias(other), F.col("key").alias(key)) for test in ("not kept", "kept"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(key))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = marked.join(few(gone), same, "left_anti")
    if not again.isEmpty():
        once = out.join(few(again), same, "left_semi").dropDuplicates(["doc_id", own])
        out = out.join(few(again), same, "left_anti").unionByName(once)
    return out.drop(own)


QUERIES = {"op9_ngram_jaccard": lambda spark, sf_dir: near_duplicates(table(spark, sf_dir, "documents"), 3, (90, 100))}
ORACLE_SQL = {
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, coalesce(any_value(links.n_links), 0) AS n_links
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN links ON links.a = d.doc_id GROUP BY d.doc_id, n.n
"""
}
