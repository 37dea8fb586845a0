"""Words of Arrow string columns as 64-bit hashes, without a Python object per word.

Words are runs of bytes other than space and \\x09-\\x0D, in lower case (A-Z only). A word's hash is a
polynomial over its bytes modulo 2 ** 64, taken from running sums over the buffer, then mixed. Buffers
are worked through in windows of WINDOW bytes, ended at a place where no word is cut, so that what is
held stays bounded by the window, or by the longest word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the bounds of its rows in them; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _word_bounds(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; breaks: places where a row begins."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[breaks < len(raw)]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    last[before] = inside[before]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1


def words(raw: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of every word, and the number of words before each row [rows + 1]."""
    hashes, starts = [], []
    at, n = 0, len(raw)
    inner = np.unique(bounds)
    while at < n:
        end = min(n, at + window)
        while end < n:
            # back to a place where a row begins or white space stands; forward if a word fills the window
            row = int(inner[np.searchsorted(inner, end, "right") - 1])
            space = np.nonzero(_SPACE[raw[max(at, row) : end]])[0]
            cut = max(at, row) + int(space[-1]) + 1 if len(space) else row
            if cut > at:
                end = cut
                break
            end = min(n, end + window)
        part = _LOWER[raw[at:end]]
        a, b = _word_bounds(part, inner[(inner >= at) & (inner < end)] - at)
        size = 1 << max(12, (len(part) - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        starts.append(a + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, s, np.searchsorted(s, bounds, "left")


def slices(texts: pa.Array, most: int = 4 * WINDOW):
    """(first row, rows) of runs of rows of about `most` bytes together."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, bounds = buffer(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, min(end, len(texts)) - at
        at = end


def hash_word(word: bytes) -> int:
    """The hash of one word, as words() has it."""
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])
