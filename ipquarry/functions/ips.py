"""IP addresses as binary columns: 4 bytes for IPv4, 16 for IPv6, network order.

Spark compares binary unsigned and byte by byte, which is the order of addresses within a family. All
column functions are built-in expressions, so they stay in the JVM.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUPS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
IPV6 = rf"^({_GROUPS})?(::({_GROUPS})?)?$"


def _sql(column: Column | str, make) -> Column:
    """make(name) as an expression over a column that is evaluated once for each row."""
    source = F.col(column) if isinstance(column, str) else column
    return F.element_at(F.transform(F.array(source), lambda s: make(s)), 1)


def parse_ipv4(column: Column | str) -> Column:
    """Four bytes, or null for anything but four decimal octets without leading zeros."""
    c = F.col(column) if isinstance(column, str) else column
    head, tail = F.substring_index(c, ".", 2), F.substring_index(c, ".", -2)
    octets = [F.substring_index(head, ".", 1), F.substring_index(head, ".", -1), F.substring_index(tail, ".", 1), F.substring_index(tail, ".", -1)]
    number = sum((o.cast("long") * 256 ** (3 - k) for k, o in enumerate(octets)), F.lit(0))
    # the test goes first, so the casts see digits only
    return F.when(c.rlike(IPV4), F.unhex(F.lpad(F.hex(number), 8, "0")))


def parse_ipv6(column: Column | str) -> Column:
    """Sixteen bytes (four for mapped IPv4), or null; `::` once, a dotted tail allowed, no zone."""

    def make(s: Column) -> Column:
        low = F.lower(s)
        tail = F.regexp_extract(low, r":([0-9]+\.[0-9.]+)$", 1)
        as_hex = F.lower(F.hex(parse_ipv4(tail)))
        plain = F.when(tail == "", low).when(tail.rlike(IPV4), F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(tail)), F.substring(as_hex, 1, 4), F.lit(":"), F.substring(as_hex, 5, 4)))

        def filled(side: Column) -> Column:
            return F.when(side == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(side, ":"), lambda g: F.lpad(g, 4, "0")), ""))

        def whole(t: Column) -> Column:
            short = t.contains("::")
            left, right = filled(F.split_part(t, F.lit("::"), F.lit(1))), filled(F.split_part(t, F.lit("::"), F.lit(2)))
            given = F.length(left) + F.length(right)
            ok = t.rlike(IPV6) & F.when(short, given <= 28).otherwise(given == 32)
            return F.when(ok, F.unhex(F.concat(left, F.repeat(F.lit("0"), F.greatest(F.lit(0), 32 - given)), right)))

        full = F.element_at(F.transform(F.array(plain), whole), 1)
        mapped = F.hex(F.substring(full, 1, 12)) == "00000000000000000000FFFF"
        return F.when(mapped, F.substring(full, 13, 4)).otherwise(full)

    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.contains(":"), _sql(c, make))


def parse_ip(column: Column | str) -> Column:
    """The address as bytes, or null."""
    return F.coalesce(parse_ipv4(column), parse_ipv6(column))


def family(ip: Column | str) -> Column:
    """4 or 6, by length."""
    return F.when(F.octet_length(ip) == 4, 4).when(F.octet_length(ip) == 16, 6).cast("tinyint")


def format_ip(column: Column | str) -> Column:
    """Canonical text: dotted IPv4; IPv6 in lower case with the first longest run of zero groups shortened."""
    c = F.col(column) if isinstance(column, str) else column
    number = F.conv(F.hex(c), 16, 10).cast("long")
    four = F.concat_ws(".", *(F.shiftrightunsigned(number, 24 - 8 * k).bitwiseAND(255).cast("string") for k in range(4)))
    group = lambda k: F.lower(F.conv(F.substring(F.hex(c), 4 * k + 1, 4), 16, 16))
    padded = F.concat(F.lit(":"), F.concat_ws(":", *(group(k) for k in range(8))), F.lit(":"))

    def shortened(p: Column) -> Column:
        out = F.substr(p, F.lit(2), F.length(p) - 2)
        for run in range(2, 9):  # the longest decides, so it's asked first, being wrapped last
            zeros = ":" + "0:" * run
            at = F.instr(p, zeros)
            head, rest = F.substr(p, F.lit(2), F.greatest(at - 2, F.lit(0))), F.substr(p, at + len(zeros))
            out = F.when(at > 0, F.concat(head, F.lit("::"), F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0))))).otherwise(out)
        return out

    return F.when(F.octet_length(c) == 4, four).when(F.octet_length(c) == 16, _sql(padded, shortened))


def ipv4_number(ip: Column | str) -> Column:
    """An IPv4 address as a number; null for others."""
    c = F.col(ip) if isinstance(ip, str) else ip
    return F.when(F.octet_length(c) == 4, F.conv(F.hex(c), 16, 10).cast("long"))


@dataclass(frozen=True)
class Range:
    """A closed range of addresses of one family."""

    lo: bytes
    hi: bytes

    @property
    def family(self) -> int:
        return 4 if len(self.lo) == 4 else 6

    def contains(self, ip: Column | str) -> Column:
        """A predicate with literal bounds, which a Parquet scan can push down."""
        c = F.col(ip) if isinstance(ip, str) else ip
        return (F.octet_length(c) == len(self.lo)) & c.between(F.lit(bytearray(self.lo)), F.lit(bytearray(self.hi)))


def parse_address(text: str) -> bytes:
    """Bytes of one address; mapped IPv4 becomes four bytes. Raises ValueError."""
    try:
        if "%" in text:
            raise ValueError
        found = ipaddress.ip_address(text)
    except ValueError:
        raise ValueError(f'Invalid IP Address "{text}"') from None
    mapped = getattr(found, "ipv4_mapped", None)
    return (mapped or found).packed


def cidr_bounds(text: str) -> Range:
    """First and last address of a block; host bits are cleared. The prefix length is required."""
    if not re.fullmatch(r"[^/%]+/[0-9]+", text):
        raise ValueError(f"invalid CIDR address: {text}")
    try:
        block = ipaddress.ip_network(text, strict=False)
    except ValueError:
        raise ValueError(f"invalid CIDR address: {text}") from None
    return Range(block.network_address.packed, block.broadcast_address.packed)


def query_range(text: str) -> Range:
    """The range that a search is for: a block if there is a slash, else one address."""
    if "/" in text:
        return cidr_bounds(text)
    one = parse_address(text)
    return Range(one, one)
