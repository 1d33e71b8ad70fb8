"""Addresses in urls as numbers, and whether they may be fetched.

An address is a struct ``(v, hi, lo)``: its version and its 128 bits as two signed numbers; version 4 has its 32 bits in ``lo``. Everything is
column functions, so that urls are judged where they are scanned. Names that are no addresses need a table of what they resolve to.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C

#: Scheme and host of a url; the host of a version 6 address stands in brackets.
_URL = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def hostname(url: Column) -> Column:
    """The host in lower case, without brackets; empty if there is none."""
    return F.translate(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)), "[]", "")


def _once(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _number(x: Column) -> Column:
    """A part of a version 4 address: decimal, octal behind a 0, or hexadecimal behind 0x; null if it is none of these."""
    hexa, octal = F.regexp_extract(x, "^0x0*([0-9a-f]{1,8})$", 1), F.regexp_extract(x, "^0+([0-7]{1,11})$", 1)
    plain = F.when(x.rlike("^(0|[1-9][0-9]{0,9})$"), x.cast("bigint"))
    return F.when(hexa != "", F.conv(hexa, 16, 10).cast("bigint")).when(octal != "", F.conv(octal, 8, 10).cast("bigint")).when(x.rlike("^0x0+$|^0+$"), 0).otherwise(plain)


def v4(host: Column) -> Column:
    """The 32 bits of a version 4 address of one to four parts, the last of which fills what is left; null for anything else."""

    def read(n: Column) -> Column:
        k = F.size(n)
        room = F.element_at(F.array(*[F.lit(256 ** (5 - i)) for i in range(1, 5)]), k)
        good = F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, 1, k - 1), lambda x: x < 256) & (F.element_at(n, -1) < room)
        front = F.aggregate(F.slice(n, 1, k - 1), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
        return F.when(good, front * room + F.element_at(n, -1))

    return F.when(host.rlike(r"^[0-9a-fx]+(\.[0-9a-fx]+){0,3}$"), _once(F.transform(F.split(host, r"\."), _number), read))


def v6(host: Column) -> Column:
    """``(hi, lo)`` of a version 6 address; null for anything else. A version 4 address may stand at its end, a zone behind ``%`` is left out."""
    bare = F.regexp_replace(host, "%.*$", "")
    tail = F.regexp_extract(bare, r"(?:^|:)((?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2}))$", 1)

    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    def read(x: Column) -> Column:
        ends = F.split(x, "::", -1)
        head, back = groups(F.get(ends, F.lit(0))), groups(F.coalesce(F.get(ends, F.lit(1)), F.lit("")))
        given = F.size(head) + F.size(back)
        fits = F.when(F.size(ends) == 2, given < 8).otherwise((F.size(ends) == 1) & (given == 8))
        shape = x.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        digits = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
        whole = F.concat(digits(head), F.repeat(F.lit("0000"), F.greatest(8 - given, F.lit(0))), digits(back))
        half = lambda at: F.conv(F.substring(whole, at, 16), 16, -10).cast("bigint")
        return F.when(fits & shape, F.struct(half(1).alias("hi"), half(17).alias("lo")))

    # A version 4 address at the end is written as two groups, so that all are groups.
    four = F.lpad(F.lower(F.hex(v4(tail))), 8, "0")
    even = F.when(tail == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))
    return F.when(host.contains(":"), _once(even, read))


def address(host: Column) -> Column:
    """The address that a host is written as; null for names."""
    of = lambda v, hi, lo: F.struct(F.lit(v).alias("v"), hi.alias("hi"), lo.alias("lo"))
    four = _once(v4(host), lambda n: F.when(n.isNotNull(), of(4, F.lit(0).cast("bigint"), n)))
    six = _once(v6(host), lambda a: F.when(a.isNotNull(), of(6, a["hi"], a["lo"])))
    return F.when(host.contains(":"), six).otherwise(four)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def bounds(network: str) -> tuple[int, int, int, int, int]:
    """Version, mask and bits of a network, both as ``hi`` and ``lo``."""
    n = ipaddress.ip_network(network)
    mask, net = int(n.netmask), int(n.network_address)
    return n.version, _signed(mask >> 64), _signed(mask & (2**64 - 1)), _signed(net >> 64), _signed(net & (2**64 - 1))


def within(a: Column, networks: list[str]) -> Column:
    """Whether an address is in one of a few fixed networks; those of the other version hold nothing."""

    def one(network: str) -> Column:
        v, mask_hi, mask_lo, hi, lo = bounds(network)
        own = (a["v"] == v) & (a["lo"].bitwiseAND(F.lit(mask_lo).cast("bigint")) == F.lit(lo).cast("bigint"))
        return own if v == 4 else own & (a["hi"].bitwiseAND(F.lit(mask_hi).cast("bigint")) == F.lit(hi).cast("bigint"))

    return reduce(lambda x, y: x | y, map(one, networks))


def embedded(a: Column) -> Column:
    """The version 4 address within a version 6 one: mapped, of 6to4, or of Teredo, which has its bits turned; null for others."""
    low = F.lit((1 << 32) - 1).cast("bigint")
    mapped = (a["hi"] == 0) & (F.shiftright(a["lo"], 32) == 0xFFFF)
    six_to_four = F.shiftrightunsigned(a["hi"], 48) == 0x2002
    teredo = F.shiftrightunsigned(a["hi"], 32) == 0x20010000
    n = F.when(mapped, a["lo"].bitwiseAND(low)).when(six_to_four, F.shiftrightunsigned(a["hi"], 16).bitwiseAND(low)).when(teredo, F.bitwise_not(a["lo"]).bitwiseAND(low))
    return F.when((a["v"] == 6) & n.isNotNull(), F.struct(F.lit(4).alias("v"), F.lit(0).cast("bigint").alias("hi"), n.alias("lo")))


def internal(a: Column) -> Column:
    """Whether an address is private, local, reserved or for many, by itself or by what it holds."""

    def held(e: Column) -> Column:
        return F.coalesce(within(e, C.V4_INTERNAL) & (e["lo"] != 0), F.lit(False))

    return F.when(a["v"] == 4, within(a, C.V4_BLOCKED)).otherwise(within(a, C.V6_BLOCKED) | _once(embedded(a), held))


def verdict(url: Column) -> Column:
    """Why a url may not be fetched: ``scheme``, ``host``, ``metadata`` or ``internal``; ``name`` if that hangs on what its name resolves to; else empty."""
    h = hostname(url)
    judged = lambda a: F.when(a.isNull(), "name").when(internal(a), "internal").otherwise("")
    return F.when(~scheme(url).isin("http", "https"), "scheme").when(h == "", "host").when(h.isin(C.METADATA_HOSTS), "metadata").otherwise(_once(address(h), judged))


def judged(urls: DataFrame, key: str, url: str, resolved: DataFrame | None = None) -> DataFrame:
    """Rows ``(key, verdict)``. ``resolved`` has ``(host, ip)``, all addresses of names; one that is internal blocks the name.

    A name without addresses, or only with texts that are none, is ``unresolved``. Hosts may be hot: each has one row in the join.
    """
    d = urls.select(F.col(key), verdict(F.col(url)).alias("_v"), hostname(F.col(url)).alias("_host"))
    if resolved is None:
        return d.select(key, F.when(F.col("_v") == "name", "unresolved").otherwise(F.col("_v")).alias("verdict"))
    known = resolved.select(F.lower("host").alias("_host"), address(F.lower(F.trim("ip"))).alias("_a")).where("_a is not null")
    known = known.groupBy("_host").agg(F.max(internal(F.col("_a"))).alias("_bad"))
    named = F.when(F.col("_bad").isNull(), "unresolved").when(F.col("_bad"), "internal").otherwise("")
    return d.join(known, "_host", "left").select(key, F.when(F.col("_v") == "name", named).otherwise(F.col("_v")).alias("verdict"))


def networks_of(addresses: DataFrame, key: str, a: str, networks: DataFrame) -> DataFrame:
    """Rows ``(key, network)``: the smallest of a table's networks that each address is in. ``networks`` has ``(network, v, mask_hi, mask_lo, hi, lo)``.

    For many networks: each address is cut by the masks that the table has, at most 161 of them, and meets networks by equality. An address
    that is in none has no row. ``key`` must tell the rows apart.
    """
    masks = networks.select("v", "mask_hi", "mask_lo").distinct().groupBy("v").agg(F.collect_list(F.struct("mask_hi", "mask_lo")).alias("_m"))
    d = addresses.select(F.col(key), F.col(a).alias("_a")).withColumn("v", F.col("_a.v")).join(F.broadcast(masks), "v").withColumn("_m", F.explode("_m"))
    d = d.select(key, "v", "_m.*", F.col("_a.hi").bitwiseAND(F.col("_m.mask_hi")).alias("hi"), F.col("_a.lo").bitwiseAND(F.col("_m.mask_lo")).alias("lo"))
    found = d.join(networks, ["v", "mask_hi", "mask_lo", "hi", "lo"])
    return found.groupBy(key).agg(F.max_by("network", F.struct(F.bit_count("mask_hi") + F.bit_count("mask_lo"), "network")).alias("network"))
