"""Log files for tests, written byte by byte."""

import bz2
import gzip
import ipaddress
import json
import lzma
import struct

FIELDS = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice"


def tsv(pairs, fields=FIELDS):
    rows = [f"1426{i}\tC{i}\t{a}\t1\t{b}\t2\ttcp\t-" for i, (a, b) in enumerate(pairs)]
    return "\n".join(["#separator \\x09", fields, "#types\ttime", *rows, "#close\tx", ""])


def packet(src, dst, vlans=0, inner=None):
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    kind = 0x0800 if a.version == 4 else 0x86DD
    tags = b"".join(struct.pack(">HH", 0x8100, 7) for _ in range(vlans))
    body = (ip_header(inner[0], inner[1], 17, 8) + b"\0" * 8) if inner else b"\0" * 8
    protocol = 17 if not inner else (4 if ipaddress.ip_address(inner[0]).version == 4 else 41)
    return b"\x01" * 6 + b"\x02" * 6 + tags + struct.pack(">H", kind) + ip_header(src, dst, protocol, len(body)) + body


def ip_header(src, dst, protocol, size):
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        return struct.pack(">BBHHHBBH", 0x45, 0, 20 + size, 0, 0, 64, protocol, 0) + a.packed + b.packed
    return struct.pack(">IHBB", 0x60000000, size, protocol, 64) + a.packed + b.packed


def pcap(packets, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(packets):
        out += struct.pack(order + "IIII", 1000 + i, 5, len(p), len(p)) + p
    return out


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = content.encode() if isinstance(content, str) else content
    for end, pack in ((".gz", gzip.compress), (".xz", lzma.compress), (".bz2", bz2.compress)):
        if path.name.endswith(end):
            data = pack(data)
    path.write_bytes(data)
    return str(path)


def json_lines(rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"
