"""Queries on the safety of addresses, with their SQL, which works on the numbers that the urls are written from."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import net as N
from ..sources.tables import table
from .queries import query

#: Numbers of addresses from page ids: every other one in or beside a network that is blocked.
_EDGES = sorted({int(x) + k for n in C.V4_BLOCKED for x in (ipaddress.ip_network(n)[0], ipaddress.ip_network(n)[-1]) for k in (-1, 0, 1) if 0 <= int(x) + k < 2**32})
_N = "(CASE WHEN page_id % 2 = 0 THEN (page_id * 2654435761 + 12345) % 4294967296 ELSE e[1 + (page_id // 2) % len(e)] END)"
#: Urls of these numbers in nine forms.
_FORMS = [
    "'http://' || a || '.' || b || '.' || c || '.' || d || '/'",
    "'https://' || n || ':8080/x'",
    "'http://0x' || lower(hex(n)) || '?q'",
    "'http://u@' || a || '.' || (n % 16777216) || '#f'",
    "'http://' || a || '.0x' || lower(hex(b)) || '.' || (n % 65536)",
    "'http://[::ffff:' || a || '.' || b || '.' || c || '.' || d || ']/'",
    "'http://[2002:' || lower(hex(n // 65536)) || ':' || lower(hex(n % 65536)) || '::1]:80/'",
    "'ftp://' || a || '.' || b || '.' || c || '.' || d",
    "url",
]
_URLS = f"""
x AS (SELECT page_id, url, {_N}::BIGINT AS n FROM pages, (SELECT {_EDGES}::BIGINT[] AS e)),
p AS (SELECT *, n // 16777216 AS a, (n // 65536) % 256 AS b, (n // 256) % 256 AS c, n % 256 AS d FROM x),
u AS (SELECT page_id, n, CASE page_id % {len(_FORMS)} {" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS))} END AS u FROM p)
"""


def _in(networks: list[str]) -> str:
    return "(" + " OR ".join(f"n BETWEEN {int(ipaddress.ip_network(x)[0])} AND {int(ipaddress.ip_network(x)[-1])}" for x in networks) + ")"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    edges = F.array(*[F.lit(e).cast("bigint") for e in _EDGES])
    edge = F.element_at(edges, (1 + F.floor(F.col("page_id") / 2) % len(_EDGES)).cast("int"))
    p = p.withColumn("n", F.when(F.col("page_id") % 2 == 0, (F.col("page_id") * 2654435761 + 12345) % (1 << 32)).otherwise(edge).cast("bigint"))
    byte = lambda i: F.shiftright("n", 24 - 8 * i).bitwiseAND(F.lit(255).cast("bigint"))
    p = p.withColumns({c: byte(i) for i, c in enumerate("abcd")})
    form = "CASE page_id % " + str(len(_FORMS)) + " " + " ".join(f"WHEN {i} THEN {f.replace('//', 'DIV') if 'n //' in f else f}" for i, f in enumerate(_FORMS)) + " END"
    return p.select("page_id", F.expr(form.replace("http:DIV", "http://")).alias("u"))


_VERDICT = f"""CASE page_id % {len(_FORMS)} WHEN 7 THEN 'scheme' WHEN 8 THEN 'unresolved'
WHEN 0 THEN CASE WHEN n = {int(ipaddress.ip_address(C.METADATA_HOSTS[1]))} THEN 'metadata' WHEN {_in(C.V4_BLOCKED)} THEN 'internal' ELSE '' END
WHEN 5 THEN CASE WHEN n <> 0 AND {_in(C.V4_INTERNAL)} THEN 'internal' ELSE '' END WHEN 6 THEN CASE WHEN n <> 0 AND {_in(C.V4_INTERNAL)} THEN 'internal' ELSE '' END
ELSE CASE WHEN {_in(C.V4_BLOCKED)} THEN 'internal' ELSE '' END END"""


@query(f"WITH {_URLS} SELECT page_id, u AS url, {_VERDICT} AS verdict FROM u")
def url_safety(spark, d):
    urls = _urls(spark, d)
    return urls.join(N.judged(urls, "page_id", "u"), "page_id").select("page_id", F.col("u").alias("url"), "verdict")


@query(f"WITH {_URLS}, v AS (SELECT page_id, {_VERDICT} AS verdict FROM u) SELECT verdict, count(*) AS n, min(page_id) AS first FROM v GROUP BY verdict")
def url_safety_partition(spark, d):
    """How many urls are safe, and how many are blocked for each reason."""
    return N.judged(_urls(spark, d), "page_id", "u").groupBy("verdict").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


#: Networks of 8 to 19 bits, one from the number of each order.
_NETS = "SELECT DISTINCT 8 + o_orderkey % 12 AS bits, ((o_orderkey * 2654435761) % 4294967296) >> (24 - o_orderkey % 12) AS net FROM orders"


@query(f"""WITH {_URLS}, k AS ({_NETS}), m AS (SELECT page_id, bits, net, row_number() OVER (PARTITION BY page_id ORDER BY bits DESC) AS i FROM u JOIN k ON n >> (32 - bits) = net)
SELECT page_id, net::VARCHAR || '/' || bits AS network FROM m WHERE i = 1 AND page_id % {len(_FORMS)} < 5""")
def url_networks(spark, d):
    k = table(spark, d, "orders").select((8 + F.col("o_orderkey") % 12).alias("bits"), F.expr("shiftright(o_orderkey * 2654435761 % 4294967296, cast(24 - o_orderkey % 12 as int))").alias("net")).distinct()
    mask = F.expr("4294967295 - shiftleft(1L, cast(32 - bits as int)) + 1")
    nets = k.select(F.concat_ws("/", F.col("net").cast("string"), F.col("bits").cast("string")).alias("network"), F.lit(4).alias("v"), F.lit(-1).cast("bigint").alias("mask_hi"), (F.lit(-(1 << 32)).cast("bigint") + mask).alias("mask_lo"), F.lit(0).cast("bigint").alias("hi"), F.expr("shiftleft(net, cast(32 - bits as int))").alias("lo"))
    urls = _urls(spark, d).where(F.col("page_id") % len(_FORMS) < 5).select("page_id", N.address(N.hostname(F.col("u"))).alias("a"))
    return N.networks_of(urls, "page_id", "a", nets)
