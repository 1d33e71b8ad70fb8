import pytest
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import relational as R
from millrace.plans import content, dom, matching, safety, streams  # noqa: F401
from millrace.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(name, same):
    same(Q.QUERIES[name], Q.SQL[name])


def test_next_page_over_gaps_and_repeats(spark, tmp_path, same):
    wall = ["http://a.com/x", "http://login.a.com/y", "http://b.org/", "http://a.com/", None]
    rows = [(i * i * 7 - 300, wall[i * 5 // 3 % 5]) for i in range(60)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    same(Q.QUERIES["url_auto_transfer"], Q.SQL["url_auto_transfer"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"), str(tmp_path))
    more = spark.createDataFrame([*rows, (-300, "http://c.net/"), (-293, None), (None, "u"), (None, None)], "page_id bigint, url string")
    got = R.following(more, "page_id", "url", "next").collect()
    order = sorted(more.collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.url is None, r.url or ""))
    want = [(*r, b) for r, b in zip(order, [r.url for r in order[1:]] + [None])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_clusters_are_at_most_eight_and_cover_all_vectors(spark):
    rows = Q.kmeans_clusters(spark, "/root/testdata/sf0.001").collect()
    assert len({r.vec_id for r in rows}) == len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert 2 <= len({r.cluster for r in rows}) <= 8


def test_stream_ends_with_the_state_of_the_batch(spark):
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(Q.stream_job_state(spark, "/root/testdata/sf0.001")) == key(Q.reconcile_status(spark, "/root/testdata/sf0.001"))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())


def test_numbers_over_ties_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(i * 7 % 13, "s", i) for i in range(60)] + [(None, None, None)] * 3, "k bigint, own string, n bigint")
    got = R.numbered(rows, "k", "at", 5).collect()
    assert sorted(r["at"] for r in got) == list(range(5, 68))
    assert [r.k for r in sorted(got, key=lambda r: r["at"])] == sorted(r.k for r in got if r.k is not None) + [None] * 3
    assert R.numbered(rows.limit(0), "k").count() == 0


def test_lists_of_urls(spark):
    pasted = ["https://a.test/1%0Ahttps://a.test/1?utm_id=3https://b.test/x http://a.test/1", "no url ftp://c.test", "", None, "<https://d.test/?q=1>、\t'https://d.test/?q=1#x'"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(pasted)], "i int, x string")
    got = {r.i: r.u for r in rows.select("i", U.listed(F.col("x")).alias("u")).collect()}
    assert got == {0: ["https://a.test/1", "https://b.test/x", "http://a.test/1"], 1: [], 2: [], 3: [], 4: ["https://d.test/?q=1"]}


def test_attempts_end_behind_three_failures_or_the_deadline(spark):
    rows = [("a", i, i in (1, 2, 4, 5, 6), 1) for i in range(9)] + [("b", i, True, 400) for i in range(2)] + [("c", 0, None, None)]
    d = spark.createDataFrame(rows, "job string, at int, bad boolean, s int")
    got = {(r.job, r["at"]): r.attempted for r in R.attempts(d, "job", ["at"], F.col("bad"), F.col("s"), limit=300).collect()}
    assert [got["a", i] for i in range(9)] == [True] * 7 + [False] * 2 and got["b", 0] and not got["b", 1] and got["c", 0]
