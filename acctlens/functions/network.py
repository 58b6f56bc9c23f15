"""IP addresses and networks of both families as column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from acctlens.functions import text as tx

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ip_to_long(ip: Column) -> Column:
    """Number of a dotted address; NULL for anything else."""
    number = F.aggregate(
        F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda acc, part: acc * 256 + part.try_cast("bigint")
    )
    return F.when(ip.rlike(_IPV4), number)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _groups(text: Column) -> Column:
    """The eight groups of a written IPv6 address, its short form (``::``) written out; else anything but eight."""
    def side(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def filled(sides: Column) -> Column:
        # Both sides at once, as an array of arrays; between them there is one group at least.
        return _let(F.array(side(sides[0]), side(sides[1])), lambda two: _let(
            F.lit(8) - F.size(two[0]) - F.size(two[1]),
            lambda gap: F.when(gap >= 1, F.concat(two[0], F.array_repeat(F.lit("0"), gap), two[1]))))

    def whole(sides: Column) -> Column:
        return F.when(F.size(sides) == 1, F.split(text, ":")).when(F.size(sides) == 2, filled(sides))

    return _let(F.split(text, "::"), whole)


def _six(text: Column) -> Column:
    """(family, high, low) of a written IPv6 address; NULL for anything else."""
    def dotted(tail: Column) -> Column:
        """The address with a dotted end as two groups."""
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        return _let(ip_to_long(tail), lambda n: F.when(n.isNull(), text).otherwise(
            F.concat(head, F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(0xFFFF))))))

    def half(numbers: Column, at: int) -> Column:
        """Four groups as one long, less 2 ** 63, so that longs are ordered as the addresses."""
        top = F.shiftleft(numbers[at] - F.lit(1 << 15), 48)
        return top + F.shiftleft(numbers[at + 1], 32) + F.shiftleft(numbers[at + 2], 16) + numbers[at + 3]

    def number(groups: Column) -> Column:
        right = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        longs = F.transform(F.when(right, groups), lambda g: F.conv(g, 16, 10).cast("bigint"))
        return _let(longs, lambda n: F.when(n.isNotNull(), address(6, half(n, 0), half(n, 4))))

    return _let(_let(F.substring_index(text, ":", -1), dotted), lambda written: _let(_groups(written), number))


def address(family: int, high: Column | int, low: Column | int) -> Column:
    """An address as it is compared: its family, and its number in two longs."""
    high, low = (c if isinstance(c, Column) else F.lit(c).cast("bigint") for c in (high, low))
    return F.struct(F.lit(family).alias("family"), high.alias("high"), low.alias("low"))


def ip_number(ip: Column) -> Column:
    """:func:`address` of a text of either family, ordered as the addresses are; NULL for what is none."""
    # The longest written form has 45 signs, so longer texts are not taken apart.
    four = _let(ip_to_long(ip), lambda n: F.when(n.isNotNull(), address(4, 0, n)))
    return F.when(F.instr(ip, ":") > 0, F.when(F.length(ip) <= 45, _six(ip))).otherwise(four)


def network_range(cidr: Column) -> Column:
    """(first, last) address of a network, or of a single address; NULL for what is no network."""
    def free_bits(width: int) -> Column:
        written = F.substring_index(cidr, "/", -1).try_cast("int")
        return F.lit(width) - F.when(F.instr(cidr, "/") > 0, written).otherwise(width)

    def spread(half: Column, bits: Column, up: bool) -> Column:
        """A long with its lowest bits, up to all 64, set or cleared."""
        kept = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.least(bits, F.lit(63)).cast("int"))
        part = half.bitwiseOR(F.bitwise_not(kept)) if up else half.bitwiseAND(kept)
        whole = F.lit((1 << 63) - 1 if up else -(1 << 63)).cast("bigint")
        return F.when(bits <= 0, half).when(bits >= 64, whole).otherwise(part)

    def end(a: Column, bits: Column, up: bool) -> Column:
        low = spread(a["low"], F.least(bits, F.lit(64)), up)
        return F.when(a["family"] == 4, address(4, 0, low)).otherwise(
            address(6, spread(a["high"], bits - 64, up), low))

    def both(a: Column) -> Column:
        width = F.when(a["family"] == 4, 32).otherwise(128)
        bits = F.when(a["family"] == 4, free_bits(32)).otherwise(free_bits(128))
        return _let(bits, lambda n: F.when(a.isNotNull() & n.between(0, width), F.struct(end(a, n, False).alias("first"), end(a, n, True).alias("last"))))

    return _let(ip_number(F.substring_index(cidr, "/", 1)), both)


def subnet(ip: Column, prefix: int) -> Column:
    """Network text of a /24 or /16 around the address."""
    keep = {24: 3, 16: 2}[prefix]
    return F.concat(F.substring_index(ip, ".", keep), F.lit(".0" * (4 - keep) + f"/{prefix}"))


def is_private(ip: Column) -> Column:
    """Prefix test of the published check; its ``172.`` is wider than the private 172.16/12 block."""
    return ip.startswith("10.") | ip.startswith("172.") | ip.startswith("192.168.")


def in_networks(ip: Column, cidrs: list[str]) -> Column:
    """Membership in any of a configured list of networks, as plain range tests without a join."""
    def literal(net: ipaddress.IPv4Network | ipaddress.IPv6Network, number: int) -> Column:
        low = (1 << 64) - 1
        return address(4, 0, number) if net.version == 4 else address(6, (number >> 64) - (1 << 63), (number & low) - (1 << 63))

    nets = [ipaddress.ip_network(cidr, strict=False) for cidr in cidrs]
    ends = [(literal(n, int(n.network_address)), literal(n, int(n.broadcast_address))) for n in nets]

    def test(a: Column) -> Column:
        return reduce(or_, [(a >= first) & (a <= last) for first, last in ends], F.lit(False))

    return F.coalesce(_let(ip_number(ip), test), F.lit(False))


def message_ip(message: Column) -> Column:
    """Address in a callout message ``IP=<JSON or plain address> | DB_STATUS=<code>``."""
    part = F.substring_index(tx.after(message, "IP="), " | DB_", 1)
    return tx.json_field_or_raw(part, "ip")


def callout_verdict(message: Column, allowed: list[str]) -> Column:
    """Why a call failed: its address is not listed, or it is and something else rejects it."""
    ip = message_ip(message)
    inside = in_networks(ip, allowed)
    return (
        F.when(ip.isNull(), "no address")
        .when(inside & message.contains("DB_STATUS=403"), "listed but rejected")
        .when(~inside, F.concat(F.lit("not listed: add "), ip, F.when(F.instr(ip, ":") > 0, "/128").otherwise("/32")))
        .when(message.contains("DB_STATUS=200"), "works")
        .otherwise("listed")
    )

