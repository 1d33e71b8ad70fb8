"""Column functions on urls. Host and path are taken apart with one pattern; nothing throws on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import SPACE, has_any, strip

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(strip(F.coalesce(url, F.lit(""))), _PARTS, i)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 4)


def registered(h: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(F.lower(h), ".", -2)


def canonical(url: Column) -> Column:
    """Key of a url for telling repeats: no fragment, default port, tracking parameter or trailing slash; parameters sorted."""
    scheme, port, p = F.lower(part(url, 1)), part(url, 3), path(url)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.concat(host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    p = F.when(p == "", "/").when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    pairs = F.filter(F.split(part(url, 5), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(C.TRACKING))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))), "&")
    whole = F.concat(scheme, F.lit("://"), netloc, p, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host(url) == "", F.lower(strip(F.coalesce(url, F.lit(""))))).otherwise(whole)


def source_type(url: Column) -> Column:
    u, out = F.lower(F.coalesce(url, F.lit(""))), F.lit(C.DEFAULT_SOURCE)
    for kind, marks in reversed(C.SOURCES.items()):
        out = F.when(has_any(u, marks), kind).otherwise(out)
    return out


def region(url: Column) -> Column:
    h, u = host(url), F.lower(F.coalesce(url, F.lit("")))
    return F.when(has_any(h, C.REGION_HK), "HK").when(has_any(h, C.REGION_TW) | has_any(u, C.REGION_TW_URL), "TW").otherwise("?")


def page_flag(url: Column) -> Column:
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(p == "", "首頁").when(has_any(F.lower(url), C.LISTING), "列表頁").otherwise("")


def transfer_reason(url: Column, final: Column) -> Column:
    """Why a visit ended elsewhere than at the article: domain, subdomain, home or path; empty if it did not."""
    a, b = host(url), host(final)
    sub_a, sub_b = F.substring_index(a, ".", 1), F.substring_index(b, ".", 1)
    p, q = F.regexp_replace(path(url), "/+$", ""), F.regexp_replace(path(final), "/+$", "")
    return (
        F.when(b == "", "")
        .when(registered(a) != registered(b), "domain")
        .when(sub_b.isin(C.WALL_SUBDOMAINS) & (sub_a != sub_b), "subdomain")
        .when((F.length(p) > 1) & (q == ""), "home")
        .when(has_any(F.lower(q), C.WALL_PATHS), "path")
        .otherwise("")
    )


def listed(raw: Column) -> Column:
    """The http urls of a pasted list, in order; of those with one key the first.

    They may be separated by white space, also percent-encoded, or stand directly behind one another.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "%0[aAdD]", "\n"), "%(?:20|09)", " ")
    pieces = F.split(F.regexp_replace(text, "(https?://)", " $1"), SPACE + "+")
    pieces = F.transform(pieces, lambda x: F.regexp_replace(x, C.LIST_MARKS, ""))
    pieces = F.filter(pieces, lambda x: x.startswith("http://") | x.startswith("https://"))
    keyed = F.transform(pieces, lambda x: F.struct(x.alias("url"), canonical(x).alias("key")))

    def first(found: Column) -> Column:
        keys = F.transform(found, lambda x: x["key"])
        return F.transform(F.filter(found, lambda x, i: (F.array_position(keys, x["key"]) == i + 1) & (x["key"] != "")), lambda x: x["url"])

    # a lambda over an array of one binds the keyed pieces once
    return F.get(F.transform(F.array(keyed), first), F.lit(0))
