"""Packet captures: classic pcap files, parsed by the task that opens them."""

from __future__ import annotations

import ipaddress
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ipquarry.sources import lines

#: Magic -> (byte order, fractions of a second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
_VLAN = (0x8100, 0x88A8)


def packets(source):
    """(seconds, fraction, bytes) of each packet; a cut-off last one ends the file."""
    head = source.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        raise ValueError("not a pcap file")
    order, unit = MAGIC[head[:4]]
    if struct.unpack(order + "I", head[20:24])[0] & 0xFFFF != 1:
        raise ValueError("only Ethernet captures are read")
    while len(top := source.read(16)) == 16:
        seconds, fraction, size, _ = struct.unpack(order + "IIII", top)
        data = source.read(size)
        if len(data) < size:
            return
        yield seconds, fraction / unit, data


def addresses(data: bytes) -> list[bytes]:
    """Source and destination of each IP header, outermost first, through VLAN tags and IP in IP."""
    out: list[bytes] = []
    if len(data) < 14:
        return out
    at, kind = 14, struct.unpack_from(">H", data, 12)[0]
    while kind in _VLAN and len(data) >= at + 4:
        kind = struct.unpack_from(">H", data, at + 2)[0]
        at += 4
    inner = {0x0800: 4, 0x86DD: 41}.get(kind)
    while inner:
        if inner == 4 and len(data) >= at + 20 and data[at] >> 4 == 4:
            out += [data[at + 12 : at + 16], data[at + 16 : at + 20]]
            size, fragment = (data[at] & 15) * 4, struct.unpack_from(">H", data, at + 6)[0] & 0x1FFF
            inner, at = data[at + 9] if not fragment else 0, at + max(size, 20)
        elif inner == 41 and len(data) >= at + 40 and data[at] >> 4 == 6:
            for a in (at + 8, at + 24):
                one = ipaddress.IPv6Address(data[a : a + 16])
                out.append(one.ipv4_mapped.packed if one.ipv4_mapped else one.packed)
            inner, at = data[at + 6], at + 40
        else:
            break
        inner = inner if inner in (4, 41) else 0
    return out


def describe(seconds: int, fraction: float, found: list[bytes]) -> str:
    """A line for a packet: its time and addresses."""
    pairs = [f"{ipaddress.ip_address(a)} > {ipaddress.ip_address(b)}" for a, b in zip(found[::2], found[1::2])]
    return f"{seconds + fraction:.6f} " + (" ".join(pairs) or "-")


def rows(path: str):
    """(value, texts) of each packet of a file."""
    with lines.open_file(path) as source:
        for seconds, fraction, data in packets(source):
            found = addresses(data)
            yield describe(seconds, fraction, found), [str(ipaddress.ip_address(a)) for a in found]


def _parsed(salvage: bool):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from lines.batched(path, rows(path), ("value", "texts"), (pa.string(), pa.list_(pa.string())), salvage)

    return run


def read(spark: SparkSession, paths: list[str], salvage: bool = False) -> DataFrame:
    """(path, value, texts): one row per packet; value is its time and addresses."""
    return lines.paths_frame(spark, paths).mapInArrow(_parsed(salvage), "path string, value string, texts array<string>")
