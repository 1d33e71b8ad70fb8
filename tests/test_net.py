import ipaddress
import random
import socket

import pytest
from pyspark.sql import functions as F

from millrace.functions import constants as C
from millrace.functions import net as N


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")


def test_addresses_of_version_four_in_all_forms(spark):
    """As the system's own reader of addresses takes them: one to four parts, decimal, octal or hexadecimal."""
    rng = random.Random(4)
    form = lambda x: rng.choice([str, hex, lambda n: f"0{n:o}", lambda n: f"0x0{n:x}", lambda n: f"00{n:o}"])(x)
    texts = ["127.1", "2130706433", "0x7f000001", "017700000001", "0", "0x0", "4294967295", "4294967296", "256.1", "1.16777216", "1.16777215", "1.2.65536", "1.2.3.256", "1.2.3.4.5", "", ".", "1.", "1..2", "08.1", "0x", "0xg", "a", "1.2.3.x", "fx"]
    for _ in range(200):
        k = rng.randrange(1, 5)
        texts.append(".".join([form(rng.randrange(256)) for _ in range(k - 1)] + [form(rng.randrange(256 ** (5 - k)))]))
    for r in rows(spark, texts).select("t", N.v4(F.col("t")).alias("n")).collect():
        try:
            want = int.from_bytes(socket.inet_aton(r.t), "big") if r.t else None
        except OSError:
            want = None
        if r.t != "0x":
            assert r.n == want, r.t


def test_addresses_of_version_six(spark):
    rng = random.Random(6)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", "1:2", ":1", "1:", "12345::", "g::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.256", "::1.2.3", "1.2.3.4::", "fe80::1%eth0", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4"]
    for _ in range(200):
        a = ipaddress.ip_address(rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF, 0xFFFF << 64, 2**128 - 2**100 + 1]))
        texts += [a.exploded, a.compressed]
    for r in rows(spark, texts).select("t", N.v6(F.col("t")).alias("a")).collect():
        try:
            want = int(ipaddress.IPv6Address(r.t.split("%")[0]))
        except ValueError:
            want = None
        assert (None if r.a is None else ((r.a.hi % 2**64) << 64) + r.a.lo % 2**64) == want, r.t


def test_internal_addresses(spark):
    rng = random.Random(5)
    known = [ipaddress.ip_network(n) for n in C.V4_BLOCKED + C.V6_BLOCKED]
    edges = [x for n in known for x in (n[0] - 1 if int(n[0]) else n[0], n[0], n[-1], n[-1] + 1 if int(n[-1]) + 1 < 2**n.max_prefixlen else n[-1])]
    fours = [a for a in edges if a.version == 4] + [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(60)]
    sixes = [ipaddress.IPv6Address(f(int(a))) for a in fours for f in (lambda n: (0xFFFF << 32) + n, lambda n: (0x2002 << 112) + (n << 80) + 5, lambda n: (0x20010000 << 96) + (n ^ (2**32 - 1)))]
    texts = [str(a) for a in [*edges, *fours, *sixes]]

    def bad(a):
        if a.version == 4:
            return a.is_private or a.is_multicast or a.is_reserved
        e = a.ipv4_mapped or a.sixtofour
        inner = e is not None and int(e) != 0 and (e.is_private or e.is_reserved)
        return inner or any(a in n for n in known if n.version == 6)

    for r in rows(spark, texts).select("t", N.internal(N.address(F.col("t"))).alias("bad")).collect():
        assert r.bad == bad(ipaddress.ip_address(r.t)), r.t


def test_verdicts_and_names(spark):
    want = {
        "http://8.8.8.8/x": "", "https://[2606:4700::1111]:443/": "", "http://user:pw@10.0.0.1:80/": "internal", "http://[::1]/": "internal", "http://0x7f.1/": "internal", "http://[::ffff:192.168.0.1]": "internal", "http://[2002:a9fe:a9fe::]/": "internal",
        "http://[2002:808:808::]/": "", "http://metadata.google.internal/": "metadata", "HTTP://169.254.169.254/latest": "metadata", "ftp://8.8.8.8/": "scheme", "javascript:alert(1)": "scheme", "http:///x": "host", "": "scheme", None: "scheme",
        "http://good.test/a": "", "http://Bad.test/": "internal", "http://nowhere.test": "unresolved", "http://odd.test": "unresolved",
    }
    resolved = spark.createDataFrame([("good.test", "8.8.8.8"), ("good.test", "2606:4700::1111"), ("bad.test", "8.8.8.8"), ("BAD.test", " 10.1.2.3 "), ("odd.test", "x"), (None, "1.1.1.1"), ("nowhere.test", None)], "host string, ip string")
    d = rows(spark, list(want))
    assert [r.verdict for r in sorted(N.judged(d, "id", "t", resolved).collect())] == list(want.values())
    names = {"http://good.test/a", "http://Bad.test/", "http://nowhere.test", "http://odd.test"}
    assert [r.verdict for r in sorted(N.judged(d, "id", "t").collect())] == ["unresolved" if u in names else v for u, v in want.items()]


@pytest.mark.parametrize("n", [0, 500])
def test_smallest_of_many_networks(spark, n):
    rng = random.Random(n)
    nets = sorted({ipaddress.ip_network((rng.getrandbits(w) >> (w - b) << (w - b), b)) for _ in range(n) for w in [rng.choice([32, 128])] for b in [rng.randrange(1, 12)]}, key=str)
    table = spark.createDataFrame([(str(x), *N.bounds(str(x))) for x in nets], "network string, v int, mask_hi bigint, mask_lo bigint, hi bigint, lo bigint")
    hosts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)] + ["name.test"]
    got = {r.id: r.network for r in N.networks_of(rows(spark, hosts).withColumn("a", N.address(F.col("t"))), "id", "a", table).collect()}
    for i, h in enumerate(hosts[:-1]):
        own = [x for x in nets if ipaddress.ip_address(h) in x]
        assert got.get(i) == (str(max(own, key=lambda x: x.prefixlen)) if own else None)
    assert len(hosts) - 1 not in got
