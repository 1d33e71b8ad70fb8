import csv
import io
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import exports as X
from millrace.operators import relational as R
from millrace.operators import vectors as V


def test_csv_equals_the_standard_writer(spark):
    cells = [("a", 1), ('say "x", y', 2), ("line\nend", 3), ("=1+1", 4), ("-x", 5), (None, 6), ("", 7), ("\ttab", 8), ("é漢", None), ("@a,b", 9)]
    d = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cells)], "i int, t string, n int").repartition(3)
    got = X.as_csv(d, ["te,xt", "n"], ["i"], [F.col("t"), F.col("n")], bom=True).first().csv
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(["te,xt", "n"])
    writer.writerows([["'" + t if t and t[0] in "=+-@\t\r" else t or "", "" if n is None else n] for t, n in cells])
    assert got == "﻿" + out.getvalue()
    assert X.as_csv(d.limit(0), ["a"], ["i"], [F.col("t")]).first().csv == "a\r\n"


def test_numbers_are_shown_as_they_are_read(spark):
    numbers = [0.05, 1.0, 0.0009, 12.3456, 100.0, 0.0, None, 2.5]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    assert [r.s for r in d.orderBy("i").select(T.shown(F.col("n")).alias("s")).collect()] == ["" if n is None else repr(n) for n in numbers]


def test_answers_by_number(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1)], "k string, place bigint")
    told = spark.createDataFrame([("a", 2, 9, "late"), ("a", 2, 4, "first"), ("a", 0, 1, "zero"), ("a", 4, 2, "beyond"), ("a", 3, 1, None), ("a", 3, 2, "second"), ("c", 1, 1, "none"), (None, 1, 1, "null")], "k string, n bigint, t int, x string")
    got = {(r.k, r.place): (r.answer, r.failed) for r in R.positional(rows, told, ["k"], "place", "n", ["t"], "x").collect()}
    assert got == {("a", 1): (None, True), ("a", 2): ("first", False), ("a", 3): (None, True), ("b", 1): (None, True), (None, 1): (None, True)}


def test_rows_of_keys_with_names_that_clash(spark):
    d = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), (None, 3, 9), (None, 4, 9)], "k string, at int, _i int")
    assert sorted(map(tuple, R.first_of(d, ["k"], ["at"]).collect()), key=repr) == [("a", 1, 7), (None, 3, 9)]
    assert sorted(map(tuple, R.latest(d, "k", [F.desc("at")], 1).collect()), key=repr) == [("a", 2, 8), (None, 4, 9)]
    assert R.first_of(d.limit(0), ["k"], ["at"]).count() == 0 and R.distribution(d.limit(0), "k").count() == 0
    runs = spark.createDataFrame([("a", i, b) for i, b in enumerate([True, True, None, True, True, True])] + [(None, 0, True)], "k string, run int, bad boolean")
    assert [tuple(r) for r in R.runs_of_failures(runs, "k", ["run"], F.col("bad")).collect()] == [("a", 1, 3)]
    chunks = R.chunk_progress(spark.createDataFrame([("a", i, i != 4 or None) for i in range(6)], "job string, i int, ok boolean"), "job", F.col("i"), 2, F.col("ok"))
    assert [tuple(r) for r in chunks.collect()] == [("a", 3, 2, 66)]
    tried = spark.createDataFrame([("a", i, True, 1) for i in range(5)], "job string, at int, _hung boolean, _took int")
    assert [(r["_hung"], r["_took"], r.attempted) for r in R.attempts(tried, "job", ["at"], F.col("_hung"), F.col("_took")).orderBy("at").collect()] == [(True, 1, True)] * 3 + [(True, 1, False)] * 2


def test_neighbours_in_blocks_are_the_same(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").union(spark.createDataFrame([(-1, None, 0)], "vec_id bigint, embedding array<float>, label int"))
    queries = vectors.where("vec_id % 7 = 0 or vec_id < 0")
    whole, cut = V.nearest(vectors, queries), V.nearest(vectors, queries, block=3)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and whole.count() > 20
    assert V.nearest(vectors, queries.limit(0)).count() == 0


def test_nearest_equals_plain_sums_over_ties_lengths_and_nulls(spark):
    """Copies, opposite and zero vectors, other lengths and nulls within; no product of rows stands in the plan."""
    rng = random.Random(3)
    base = [[rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(200)] + [(200, [1.0]), (201, [1.0, None, 2.0, 3.0]), (202, None), (None, base[0]), (7, base[1]), (203, [0.0] * 4), (204, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    queries = vectors.where("vec_id % 20 = 0 or vec_id > 200")
    found = V.nearest(vectors, queries, k=7)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    cosine = F.round(V.dot(F.col("q"), F.col("embedding")) / (V.norm(F.col("q")) * V.norm(F.col("embedding")) + 1e-9), 6)
    both = queries.where("embedding is not null").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")).crossJoin(vectors.where("embedding is not null and vec_id is not null"))
    both = both.where("query <> vec_id").select("query", "vec_id", cosine.alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))
    want = both.withColumn("rank", rank).where("rank <= 7").collect()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want), key=repr) and len(want) == 7 * 14
    named = vectors.withColumn("vec_id", F.concat(F.lit("漢"), F.col("vec_id").cast("string")))
    assert V.nearest(named, named.where("vec_id = '漢7'"), k=3).where("query = vec_id").count() == 0
