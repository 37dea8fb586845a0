"""Best-fit packing of documents into fixed-length sequences by fitted length patterns.

1. Every document is encoded and ended by END; only longer ones are cut, the first piece taking the
   remainder. A task numbers its pieces of each length as it writes them.
2. The histogram of piece lengths (at most `size` rows) goes to the driver. Patterns are multisets of up
   to three occurring lengths that fill a sequence exactly, and repeats of one short length with its
   complement. Non-negative least squares fits how often to use each, accelerated projected gradient
   over the sparse pattern matrix; the counts are rounded down, never past what the histogram still has.
3. What is left is packed best-fit decreasing, on counts: of each length, all pieces that go to sequences
   with the same room are placed at once, so the work depends on `size` only, not on the corpus.
4. The plan is a list of runs: pieces of one length, ranks a to b, lie at one offset of consecutive
   sequences. A piece's rank is its number in its task plus the pieces of that length in earlier tasks,
   which a join over the (task, length) counts brings. No length's pieces are ever gathered in one task.

Token ids are those of the tokenizers library; they are computed by tiktoken from the same vocabulary,
which gives the same ids (compared once over every code point, and by a test over each 17th) in a quarter
of the time.

Defined results: null texts count as empty and are one piece of END alone; repeated rows are packed as
often as they occur; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ipquarry.llm.common import stored, table, texts, trim

SIZE = 1024
END = 2
SPECIAL = {"<|endoftext|>": 50256}
RANKS = "byte_bpe_50k.tiktoken"
ROUNDS = 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


@functools.cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(path: str, text: str) -> np.ndarray:
    """The ids of a text as the tokenizers library gives them with add_special_tokens=False, then END."""
    return np.append(encoding(path).encode_to_numpy(text, allowed_special="all").astype(np.uint32), np.uint32(END))


def cuts(n: int, size: int) -> list[int]:
    """Bounds of the pieces of n tokens."""
    if n <= size:
        return [0, n]
    return [0, *range(n % size or size, n + 1, size)]


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row per piece (PIECES); part and local number the pieces of a length."""
    import public_tokenizers

    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            trim()
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(path, text.as_py())
                at = cuts(len(ids), size)
                for piece, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), seen[b - a]), strict=True):
                        column.append(value)
                    seen[b - a] += 1
            n = len(out[0])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=False)), pa.array([part] * n, pa.int32()), pa.array(out[5], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return texts(docs).mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to four lengths, 0 for none, that sum to size; lengths: those that occur, below size."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    rows = []
    a = lengths[lengths * 2 <= size]
    pair = a[have[size - a]]
    rows.append(np.stack([pair, size - pair, 0 * pair, 0 * pair], 1))
    for x in lengths[lengths * 3 <= size]:
        y = lengths[(lengths >= x) & (2 * lengths <= size - x)]
        y = y[have[size - x - y]]
        rows.append(np.stack([0 * y + x, y, size - x - y, 0 * y], 1))
    x = lengths[lengths * 3 < size]
    x = x[have[size - 3 * x]]
    rows.append(np.stack([x, x, x, size - 3 * x], 1))
    return np.concatenate(rows).astype(np.int64)


def fit(shapes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeats of each pattern whose pieces come nearest to counts."""
    if not len(shapes):
        return np.zeros(0)
    used = shapes > 0
    flat, owner = shapes[used], np.nonzero(used)[0]
    size = len(counts)

    def forward(x):
        return np.bincount(flat, x[owner], size)

    def back(r):
        return np.bincount(owner, r[flat], len(shapes))

    v = np.ones(len(shapes))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(back(forward(v))) * 1.02)
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset), sorted by length and rank."""
    left = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    ranks = np.zeros(size + 1, np.int64)
    runs, sequences = [], 0

    def put(n: int, times: int, first: int, offset: int) -> None:
        runs.append((n, int(ranks[n]), times, first, offset))
        ranks[n] += times
        left[n] -= times

    if left[size]:
        put(size, int(left[size]), 0, 0)
        sequences = int(ranks[size])
    shapes = patterns(np.nonzero(left[:size])[0], size)
    repeats = np.floor(fit(shapes, left.astype(float)) + 1e-9).astype(np.int64)
    for at in np.argsort(-repeats, kind="stable"):
        if not repeats[at]:
            break
        members, times_in = np.unique(shapes[at][shapes[at] > 0], return_counts=True)
        times = int(min(repeats[at], (left[members] // times_in).min()))
        if times:
            offset = 0
            for n in sorted(shapes[at][shapes[at] > 0].tolist(), reverse=True):
                put(n, times, sequences, offset)
                offset += n
            sequences += times
    # the rest, best-fit decreasing; open[r]: ranges (first sequence, sequences) with room r
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for n in range(size - 1, 0, -1):
        while left[n]:
            room = next((r for r in range(n, size) if rooms[r]), size)
            fits = room // n
            if room == size:
                whole = int(left[n]) // fits
                first, many = sequences, whole or 1
                sequences += many
                fits = fits if whole else int(left[n])
            else:
                first, had = rooms[room].pop()
                many = min(had, int(left[n]) // fits)
                if not many:
                    many, fits = 1, int(left[n])
                if many < had:
                    rooms[room].append((first + many, had - many))
            for i in range(fits):
                put(n, many, first, size - room + i * n)
            if room - fits * n:
                rooms[room - fits * n].append((first, many))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, size, path), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    trim()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut.join(earlier, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("local"))
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]  # ranks stay below 2 ** 48

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


QUERIES = {"op8_best_fit_packing": lambda spark, sf_dir: pack(table(spark, sf_dir, "documents"))}
ORACLE_SQL: dict[str, str] = {}
