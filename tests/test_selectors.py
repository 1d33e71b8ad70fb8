"""Selectors, paths and texts against walks over each page's own tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import constants as C
from millrace.operators import selectors as S
from millrace.plans import dom as P
from millrace.sources.nodes import elements, nodes


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "p", "ul", "li", "a", "article", "section", "br", "DIV"])
        own = "".join([rng.choice(["", "", f" id={rng.choice('xyz')}"]), rng.choice(["", f' class="{rng.choice(["k", "l k", "Box-a1B2c", "k k l m n"])}"', " class"])])
        out += f"<{tag}{own}>" + rng.choice(["", "text ", "more &amp; text "]) + (page(rng, depth + 1) if depth < 5 and tag != "br" else "") + (f"</{tag.lower()}>" if rng.random() < 0.8 and tag != "br" else "")
    return out


def selects(rows, selector):
    """Numbers of the elements, by trying every chain of ancestors."""
    tokens = re.findall(r">|[^\s>]+", selector)

    def fits(row, token):
        tag, rest = re.match(r"(\*|[\w-]+)?(.*)", token).groups()
        return (tag in (None, "*") or row[4] == tag.lower()) and all((not i or row[5] == i) and (not c or c in row[6]) and (not p or p in " ".join(row[6])) for i, c, p in re.findall(r"#([\w-]+)|\.([\w-]+)|\[class\*=\"(.*?)\"\]", rest))

    def chain(n, left):
        if not fits(rows[n], left[-1]):
            return False
        if len(left) == 1:
            return True
        up = rows[n][2]
        if left[-2] == ">":
            return up is not None and chain(up, left[:-2])
        while up is not None:
            if chain(up, left[:-1]):
                return True
            up = rows[up][2]
        return False

    return {r[0] for r in rows if chain(r[0], tokens)}


KNOWN = ["div", "*", "#x", ".k", "div.k", "p#y.l", ".k.l", "div p", "div > p", "div > p > a", "ul li a", "* *", "div div div", ".k > *", "#x .k > li a", "section article", '[class*="Box"]', 'div[class*="ox-a"] p', "nothing p", "DIV", ".k .k > .k"]


def test_selectors_equal_a_walk(spark):
    rng = random.Random(7)
    pages = [(i, f"<html><body>{page(rng)}</body></html>") for i in range(60)] + [(60, None), (61, ""), (62, "plain"), (63, "<p><p><div><p>")]
    d = spark.createDataFrame(pages, "page_id int, html string").withColumn("node", F.lit(1))
    got = {}
    for r in S.matches(nodes(d), S.steps(spark, KNOWN)).collect():
        got.setdefault((r.page_id, r.selector), set()).add(r.node)
    want = {(i, s): found for i, h in pages for s in KNOWN if (found := selects(elements(h)[0], s))}
    assert got == want and len(want) > 400


@pytest.mark.parametrize("selector", ["a:hover", "a + b", "a ~ b", "", "> a", "a[href]", "#x#y", "a, b"])
def test_what_is_not_known_is_left_out(selector):
    assert S.parsed(selector) is None


def test_elements_hold_one_another_or_are_apart():
    rng = random.Random(2)
    for _ in range(50):
        rows, text = elements(page(rng))
        for a in rows:
            assert 0 <= a[7] <= a[7] + a[8] <= len(text) + 1
            for b in rows:
                up, n = set(), b[2]
                while n is not None:
                    up.add(n)
                    n = rows[n][2]
                assert (a[0] in up) == (a[0] < b[0] <= a[1])


def test_paths_equal_a_walk(spark):
    deep = "<html><body>" + "".join(f'<div id=d{i} class="a b c d">' for i in range(30)) + "<p>x"
    pages = [(1, deep), (2, "<p>a<ul class=u><li>b"), (3, None)]
    got = {(r.page_id, r.node): r.path for r in S.paths(nodes(spark.createDataFrame(pages, "page_id int, html string")), F.lit(True)).collect()}
    for i, h in pages:
        rows = elements(h)[0]
        for r in rows:
            parts, n = [], r[0]
            while n is not None and rows[n][4] != "html" and len(parts) <= 20:
                own = rows[n]
                parts.append(own[4] + (f"#{own[5]}" if own[5] else "") + "".join(f".{c}" for c in own[6][:3]))
                n = own[2]
            assert got.get((i, r[0])) == (" > ".join(reversed(parts)) if parts else None)


def test_texts_by_the_first_selector_that_gives_one(spark):
    long, cookies = "word " * 100, "We use cookies. GDPR consent. Adchoices. " * 20
    pages = [(1, f"<div class=short>x</div><div class=main>{long}</div>"), (2, f"<div class=short>{cookies}</div><div class=main>{long}<p>end of it</div>"), (3, f"<div class=main><ul>{'<li>x</li>' * 9}</ul></div><div class=short>{long}</div>"), (4, f"<ul class=main>{f'<li>{long}</li>' * 6}</ul>"), (5, "<div class=main>x")]
    d = spark.createDataFrame(pages, "page_id int, html string")
    wanted = d.select("page_id", F.posexplode(F.array(F.lit(".short"), F.lit(".main"))).alias("ord", "selector"))
    got = {r.page_id: (r.selector, r.text) for r in S.selected_texts(d, nodes(d), wanted, S.steps(spark, [".short", ".main"])).collect()}
    assert got == {1: (".main", long.strip()), 2: (".main", f"{long.strip()}\n\nend of it"), 3: (".short", long.strip())}


def test_selectors_that_may_be_kept(spark):
    want = {"div.entry:nth-child(2)  > p": "div.entry > p", ".Story-aB3dEf p": '[class*="Story"] p', ".Story-abcdef": ".Story-abcdef", ".css-1q2w3e": "", "#post-12345": "", "#post": "#post", "": "", None: "", ".Box-a1": ".Box-a1", "article": "article", ".A-x9y8z7-b": ".A-x9y8z7-b"}
    d = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.n for r in d.select("s", S.normalised(F.col("s")).alias("n")).collect()} == want
    kept = {r.s for r in d.where(S.valid(F.col("s"))).collect()}
    assert kept == {s for s in want if s and s.lower() not in C.WIDE_SELECTORS and "12345" not in s}


def test_queries_of_pages(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.page_id: elements(r.html)[0] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    found = {(r.page_id, r.selector): (r.n, r.first, r.last) for r in P.page_selector_matches(spark, d).collect()}
    some = sorted(rows)[:8]
    want = {(i, s): (len(x), min(x), max(x)) for i in some for s in P.SELECTORS if (x := selects(rows[i], s))}
    assert {k: v for k, v in found.items() if k[0] in some} == want
    assert P.page_css_paths(spark, d).count() == sum(r[4] in ("p", "div", "article", "section", "main", "ul") for own in rows.values() for r in own)
    assert P.page_selected_text(spark, d).count() > 0


def test_a_text_is_cleaned_once(spark):
    from millrace.operators import selectors as S
    from millrace.sources.nodes import nodes

    pages = spark.createDataFrame([(1, "<article>" + "<p>Some text of a page, long enough.</p>" * 20 + "</article>")], "page_id bigint, html string")
    wanted = spark.createDataFrame([(1, i, s) for i, s in enumerate(["article p", "article", "body > article"])], "page_id bigint, ord int, selector string")
    found = S.selected_texts(pages, nodes(pages), wanted, S.steps(spark, ["article p", "article", "body > article"]))
    assert [(r.selector, r.node) for r in found.collect()] == [("article", 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("substring(") == 1
