"""Address ranges."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.functions.predicates import FIELD_SHAPES

DOTTED_QUAD = r"(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4 = rf"{DOTTED_QUAD}(?:\.{DOTTED_QUAD}){{3}}"


def ipv4_number(address: ColumnLike) -> Column:
    """Unsigned 32-bit value of a dotted quad, null for anything else."""
    a = as_column(address)
    parts = F.split(a, r"\.")
    number = sum((F.element_at(parts, i + 1).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
                 F.element_at(parts, 1).try_cast("bigint") * F.lit(256**3))
    return F.when(a.rlike(rf"\A{IPV4}\z"), number)


def _networks(cidrs: Sequence[str]):
    shape = FIELD_SHAPES["cidr"]
    if not cidrs:
        raise ValueError("no ranges given")
    for text in cidrs:
        if not re.fullmatch(shape, text) or ipaddress.ip_network(text, strict=False).prefixlen == 0:
            raise ValueError(f"range not accepted: {text}")
    return [ipaddress.ip_network(c, strict=False) for c in cidrs]


def in_cidr(address: ColumnLike, cidrs: Sequence[str]) -> Column:
    """Whether an address lies in one of the configured ranges.

    IPv4 is a hash lookup per prefix length in use (at most 32), so no range join is planned however
    long the list is. An IPv6 address is spelled out in full and compared as text with the bounds of each range.
    A range of every address is refused however it is written.
    """
    networks = _networks(cidrs)
    a = as_column(address)
    number = ipv4_number(a)
    by_length: dict[int, list[int]] = {}
    wide = []
    for network in networks:
        if network.version == 4:
            by_length.setdefault(network.prefixlen, []).append(int(network.network_address))
        else:
            wide.append(network)
    inside = F.lit(False)
    for length, values in sorted(by_length.items()):
        mask = (0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF
        inside = inside | number.bitwiseAND(F.lit(mask)).isin(*values)
    inside = F.coalesce(inside, F.lit(False))
    spelled = ipv6_hex(a)
    for network in wide:
        low, high = (f"{int(x):032x}" for x in (network.network_address, network.broadcast_address))
        inside = inside | F.coalesce(spelled.between(low, high), F.lit(False))
    return inside


def ipv6_hex(address: ColumnLike) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, null for anything else."""
    a = F.lower(as_column(address))
    quad = F.regexp_extract(a, rf":({IPV4})\z", 1)
    digits = F.lpad(F.lower(F.hex(ipv4_number(quad))), 8, "0")
    tail = F.concat(F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4)))
    text = F.when(quad == "", a).otherwise(F.concat(F.left(a, F.char_length(a) - F.char_length(quad)), tail))
    halves = F.split(text, "::")
    first, second = (F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda g: g != "") for i in (0, 1))
    missing = 8 - F.size(first) - F.size(second)
    groups = F.when(F.size(halves) == 1, F.split(text, ":")).when(
        (F.size(halves) == 2) & (missing >= 1), F.concat(first, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), second))
    right = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")) & ~text.rlike(r":::|\A:[^:]|[^:]:\z|\A:\z")
    return F.when(right, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))
