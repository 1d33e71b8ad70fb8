import pyarrow as pa

from millrace.operators import pages as P
from millrace.sources import dom
from millrace.sources.dom import parsed

PARAGRAPH = "<p>這是一段正文，內容足夠長，可以用來計算段落的品質。這裡還有更多的字，讓它更長一些。"
ARTICLE = f"<html><body><header>top</header><div id=main class=article-content><h1>Title</h1>{PARAGRAPH * 4}</div><aside class='sidebar widget'>side</aside><div id=list class=card-list><ul>{'<li><a href=x>a link text</a>' * 6}</ul></div></body></html>"


def test_blocks_are_parts_of_the_page():
    rows = parsed(ARTICLE)
    text = rows[0][-1]
    main = next(r for r in rows if r[8] == 4 and r[1] == "div")
    assert text[main[6] : main[6] + main[5]].startswith("Title 這是一段") and "top" not in text and "side" not in text
    assert next(r for r in rows if r[1] == "ul")[4]


def test_main_text(spark):
    rows = [(1, ARTICLE), (2, None), (3, "<p>short"), (4, "<div><div>" * 50 + "x" * 400)]
    got = {r.page_id: r for r in P.main_text(spark.createDataFrame(rows, "page_id bigint, html string")).collect()}
    assert got[1].resolved_by == "heuristic" and got[1].text.startswith("Title 這是一段") and "a link text" not in got[1].text
    assert (got[2].resolved_by, got[3].resolved_by, got[3].text) == ("failed", "body_fallback", "short")
    assert got[4].length == 400


def test_listing_page(spark):
    rows = [(1, "<article>a b c</article>" * 6), (2, "<article>a b c</article>"), (3, f"<article>{'x' * 900}</article><article>y</article>"), (4, "<article>abc</article>" * 2), (5, "<ul>" + "<li><a href=x>a heading of some length</a>" * 6 + "</ul>"), (6, "<ul>" + "<li>a heading of some length without a link" * 9 + "</ul>")]
    got = {r.page_id: r.listing for r in P.listing_page(spark.createDataFrame(rows, "page_id bigint, html string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_cjk_counts_and_banners_do_not(spark):
    page = f"<body><div id=a>{'<p>字字字字字字字字字字字字字字字字字字字字' * 20}</div><div id=b>{'<p>latin words in a line' * 20}</div><div>{'<p>We use cookies. GDPR consent. Adchoices.' * 40}</div>"
    rows = {r[8]: r for r in parsed(page) if r[1] == "div"}
    assert rows[40][11] and not rows[20][11]
    assert sorted(r[10] for r in parsed(page) if r[1] == "div") == [0, 0, 400]
    got = P.main_text(spark.createDataFrame([(1, page), (1, page)], "page_id bigint, html string")).collect()
    assert len(got) == 1 and "cookies" not in got[0].text


def test_pages_are_read_in_pieces(spark):
    """What a task's Python makes of one batch of many pages comes in parts of bounded size."""
    page = "<article>" + "<p class='a b'>text</p>" * 99 + "</article>"
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "h": [page, None] * 500})
    parts = [*dom.by_pieces(lambda k, h: [(k, i, None) for i in range(100)], "k bigint, node int, text string")(iter([batch]))]
    assert sum(p.num_rows for p in parts) == 100_000 and max(p.num_rows for p in parts) < dom.ROWS + 100
    long = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "h": ["x" * dom.PIECE, "y", "z"]})
    assert [p.num_rows for p in dom.by_pieces(lambda k, h: [(k,)], "k bigint")(iter([long]))] == [1, 2]
