import random
import re

from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.operators import relational as R


def best(srcset):
    """The set's words read with a look ahead."""
    words, out, i = (srcset or "").split(), [], 0
    while i < len(words):
        if words[i].endswith(","):
            out += [(words[i][:-1], 0.0)] if words[i][:-1] else []
        else:
            m = re.match(r"^(\d+(?:\.\d+)?)([wx])$", words[i + 1].rstrip(",")) if i + 1 < len(words) else None
            out.append((words[i], float(m[1]) if m else 0.0))
            i += bool(m)
        i += 1
    top = None
    for u, s in out:
        if top is None or s >= top[1]:
            top = u, s
    return top and top[0]


def test_sets_of_sources(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a.jpg", "b,c.jpg", "d.jpg,", ",", "320w", "320w,", "2x", "2.5x,", "1.x", "640w,,", "x", "100h", "e;0,0&resize=980:*"])
    sets = [None, "", " ", ",", "a.jpg", "a.jpg 1x", "a.jpg, b.jpg 2x", "a.jpg 2x, b.jpg 2x", "320w 320w"] + [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randrange(9))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(sets)), "i int, s string")
    assert {r.i: r.u for r in d.select("i", H.best_of_srcset(F.col("s")).alias("u")).collect()} == {i: best(s) for i, s in enumerate(sets)}


def test_best_image(spark):
    rows = [("a.jpg 1x", ["b.jpg 2x"], "l", "s"), (None, [None, "b.jpg 2x, c.jpg 3x"], "l", "s"), ("", [], " l ", "s"), (None, None, "data:x", "s"), ("data:y", [], None, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b array<string>, c string, d string")
    got = [r.u for r in d.orderBy("i").select(H.best_image(F.col("a"), F.col("b"), [F.col("c")], F.col("d")).alias("u")).collect()]
    assert got == ["a.jpg", "c.jpg", "l", "s", None]


def test_samples_hang_on_keys_alone(spark):
    d = spark.createDataFrame([(i % 3 if i % 7 else None, i, "x") for i in range(100)] + [(0, None, "n")], "g int, k int, _i string")
    one, two = (sorted(map(repr, R.sampled(x, ["g"], "k", 5, "s").collect())) for x in (d.coalesce(1), d.repartition(7, "k")))
    assert one == two and len(one) == 20 and R.sampled(d, ["g"], "k", 5, "t").collect() != R.sampled(d, ["g"], "k", 5, "s").collect()
    assert R.sampled(d.limit(0), ["g"], "k", 5).count() == 0


def test_best_and_second(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, 2.0), ("b", 5, None), (None, 6, 1.0), (None, 7, 3.0), ("c", 8, None)]
    d = spark.createDataFrame(rows, "g string, k int, s double")
    assert sorted(map(tuple, R.best_two(d, ["g"], "s", "k").collect()), key=repr) == sorted([("a", 1, 5.0, 5.0), ("b", 4, 2.0, None), (None, 7, 3.0, 1.0)], key=repr)


def test_confidence(spark):
    rows = [(1500.0, 0.0, True, True, 5), (0.0, None, False, False, 0), (800.0, 600.0, True, False, 4), (400.0, 500.0, False, True, 9)]
    d = spark.createDataFrame(rows, "b double, s double, h boolean, t boolean, p int")
    got = [round(r.c, 6) for r in d.select(H.confidence(*[F.col(c) for c in "bshtp"]).alias("c")).collect()]
    assert got == [1.0, 0.15, round(0.4 * 0.5 + 0.3 * 0.7 + 0.3 * 0.7, 6), round(0.3 * 0.35 + 0.3 * 0.8, 6)]
