"""Arrays as bytes: byte planes, compressed."""

from __future__ import annotations

import struct

import numpy as np


def pack(array: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T if len(array) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, n: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def narrow(array: np.ndarray) -> np.ndarray:
    """Unsigned integers as the smallest kind that holds them."""
    most = int(array.max(initial=0))
    return array.astype(next(kind for size, kind in ((8, "<u1"), (16, "<u2"), (32, "<u4"), (64, "<u8")) if most >> size == 0))


def joined(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers, one after the other; a first one in order is kept as differences."""
    out = []
    for i, column in enumerate(columns):
        if i == 0:
            column = np.diff(column.astype(np.uint64), prepend=np.uint64(0))
        column = narrow(column)
        data = pack(column)
        out.append(struct.pack("<BQI", column.dtype.itemsize, len(column), len(data)) + data)
    return b"".join(out)


def split(data: bytes) -> list[np.ndarray]:
    """What joined() was given, as 64-bit integers."""
    out, at = [], 0
    while at < len(data):
        width, n, size = struct.unpack_from("<BQI", data, at)
        column = unpack(data[at + 13 : at + 13 + size], f"<u{width}", n).astype(np.uint64)
        out.append(np.cumsum(column, dtype=np.uint64) if not out else column)
        at += 13 + size
    return out
