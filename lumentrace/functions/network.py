"""Addresses: classes and resolvers (NET-01, NET-02, NET-07)."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

#: What each class of address is said to be.
SCOPES = ("loopback", "unspecified", "link_local", "multicast", "broadcast", "cgnat", "documentation", "private", "public")
#: Fixed values: (first address, prefix length, class) in the order in which IPv4 classes are tried.
V4_BLOCKS = (
    ("127.0.0.0", 8, "loopback"), ("0.0.0.0", 32, "unspecified"), ("169.254.0.0", 16, "link_local"), ("224.0.0.0", 24, "link_local"), ("224.0.0.0", 4, "multicast"),
    ("255.255.255.255", 32, "broadcast"), ("100.64.0.0", 10, "cgnat"), ("192.0.2.0", 24, "documentation"), ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"), ("10.0.0.0", 8, "private"), ("172.16.0.0", 12, "private"), ("192.168.0.0", 16, "private"),
)


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null unless it is four numbers from 0 to 255 without leading zeros."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.transform(F.split(ip, "\\."), lambda x: x.try_cast("bigint"))
    return F.when(ip.rlike(f"^{octet}(\\.{octet}){{3}}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + F.coalesce(x, F.lit(0))))


def ipv4_scope(ip: Column) -> Column:
    """The class of an IPv4 address in built-in functions; null if it is none."""

    def scope_of(n: Column) -> Column:
        out = F.lit("public")
        for first, bits, scope in reversed(V4_BLOCKS):
            low = int(ipaddress.ip_address(first))
            out = F.when(n.between(low, low + (1 << (32 - bits)) - 1), scope).otherwise(out)
        return F.when(n.isNotNull(), out)

    return let(ipv4_number(ip), scope_of)


def _v6_scope(text: str | None) -> str | None:
    try:
        ip = ipaddress.ip_address(text) if text and "%" not in text else None
    except ValueError:
        return None
    if ip is None or ip.version == 4:
        return None
    if ip.ipv4_mapped:
        ip4 = int(ip.ipv4_mapped)
        return next((s for first, bits, s in V4_BLOCKS if ip4 >> (32 - bits) == int(ipaddress.ip_address(first)) >> (32 - bits)), "public")
    n = int(ip)
    if n in (0, 1):
        return ("unspecified", "loopback")[n]
    if n >> 118 == 0b1111111010 or n >> 120 == 0xFF and n >> 112 & 0xF == 2:
        return "link_local"
    if n >> 120 == 0xFF:
        return "multicast"
    if n >> 96 == 0x20010DB8:
        return "documentation"
    return "private" if n >> 121 == 0b1111110 else "public"


def _v6(ip: Column) -> Column:
    @F.pandas_udf("string")
    def scope(s: pd.Series) -> pd.Series:
        return s.map(_v6_scope)

    return scope(ip)


def classify_ip(ip: Column, with_v6: bool = True) -> Column:
    """struct<valid, version, scope, is_public> (NET-01); without ``with_v6`` no Python runs and IPv6 counts as invalid."""
    six = _v6(ip) if with_v6 else F.lit(None).cast("string")

    def told(s: Column) -> Column:
        scope = F.coalesce(s["four"], s["six"])
        version = F.when(s["four"].isNotNull() | s["mapped"], "IPv4").when(s["six"].isNotNull(), "IPv6")
        return F.struct(scope.isNotNull().alias("valid"), version.alias("version"), scope.alias("scope"), F.coalesce(scope == "public", F.lit(False)).alias("is_public"))

    return let(F.struct(ipv4_scope(ip).alias("four"), six.alias("six"), ip.rlike("(?i)^::ffff:[0-9.]+$").alias("mapped")), told)


def hex_address(field: Column) -> Column:
    """struct<ip, port> of a /proc/net/tcp address such as 0100007F:1F90: IPv4 in little-endian order, IPv6 in words of such (NET-07)."""
    addr, port = F.split_part(field, F.lit(":"), F.lit(1)), F.conv(F.split_part(field, F.lit(":"), F.lit(2)), 16, 10).cast("int")
    byte = lambda i: F.conv(F.substring(addr, 2 * i + 1, 2), 16, 10)
    four = F.concat_ws(".", *[byte(i) for i in (3, 2, 1, 0)])
    pair = lambda w, i: F.lower(F.concat(F.substring(addr, 8 * w + 2 * i + 1, 2), F.substring(addr, 8 * w + 2 * i - 1, 2)))
    six = F.concat_ws(":", *[pair(w, i) for w in range(4) for i in (3, 1)])
    return F.struct(F.when(F.length(addr) == 8, four).when(F.length(addr) == 32, six).alias("ip"), port.alias("port"))
