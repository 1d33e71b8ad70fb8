import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import patterns as M


def places(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)] if text and pattern else []


@pytest.mark.parametrize("longest", [1, 2, 5, 150])
def test_occurrences_equal_brute_force(spark, longest):
    rng = random.Random(longest)
    letters = "abé漢\U0001f600 .\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randrange(400))) for i in range(60)] + [(60, None), (61, ""), (62, "a"), (None, "ab" * 200)]
    patterns = [word(rng.randrange(1, longest + 1)) for _ in range(40)] + ["", None, "a", "a"]
    patterns += [t[k : k + longest] for _, t in texts[:30] for k in [rng.randrange(len(t) or 1)] if t]
    rows = spark.createDataFrame(texts, "id bigint, t string").withColumns({c: F.lit("x") for c in ("pattern", "at", "g", "gram", "piece", "own", "x", "len", "a", "p")})
    found = M.occurrences(rows, "id", "t", spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    want = sorted(((i, p, at) for i, t in texts for p in set(patterns) if p for at in places(t, p)), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want and want


def test_ten_thousand_patterns_without_a_product(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    patterns = sorted({word() for _ in range(10_000)})
    texts = [(i, " ".join(word() for _ in range(60))) for i in range(200)]
    found = M.occurrences(spark.createDataFrame(texts, "id bigint, t string"), "id", "t", spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {(r.id, r["at"], r.pattern) for r in found.collect()}
    by_length = {n: {p for p in patterns if len(p) == n} for n in range(4, 9)}
    assert got == {(i, k, t[k : k + n]) for i, t in texts for n, known in by_length.items() for k in range(len(t)) if t[k : k + n] in known}


def test_best_template(spark):
    """The longest indicator counts, one with a dot before all without; ties go to the template that comes first."""
    templates = [("plain", 2, "shop"), ("plain", 2, "shop/item/very-long-part"), ("dotted", 3, "a.co"), ("same", 4, "b.co"), ("first", 1, "a.co"), ("none", 0, None), ("empty", 0, ""), ("late", 9, "news.")]
    urls = [(1, "https://A.co/shop/item/very-long-part"), (2, "https://x/SHOP"), (3, "https://y/"), (4, None), (5, "b.co"), (6, "news.b.co")]
    found = M.best_template(spark.createDataFrame(urls, "id bigint, url string"), "id", "url", spark.createDataFrame(templates, "name string, ord int, indicator string"))
    assert sorted(map(tuple, found.collect())) == [(1, "first", "a.co"), (2, "plain", "shop"), (5, "same", "b.co"), (6, "late", "news.")]
    assert M.best_template(spark.createDataFrame(urls, "id bigint, url string"), "id", "url", spark.createDataFrame([], "name string, ord int, indicator string")).count() == 0


def test_stripped_terms_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab.$漢(\\") for _ in range(n))
    terms = [(rng.choice(["x", "y", M.C.ALL_SCOPE]), word(rng.randrange(1, 6))) for _ in range(30)]
    docs = [(i, word(rng.randrange(300)), rng.choice(["x", "y", "z", None])) for i in range(60)] + [(60, None, "x"), (61, "", "y")]
    frame = spark.createDataFrame(docs, "id bigint, t string, s string")
    got = {r.id: (r.text, r.n_terms) for r in M.stripped(frame, "id", F.col("t"), F.col("s"), spark.createDataFrame(terms, "scope string, term string")).collect()}
    for i, t, s in docs:
        own = sorted({w for scope, w in terms if scope in (s, M.C.ALL_SCOPE) and w in (t or "")}, key=lambda w: (-len(w), w))
        assert got[i] == (re.sub("|".join(map(re.escape, own)), " ", t or "") if own else t or "", len(own))
    keep = spark.createDataFrame([(terms[0][1],)], "term string")
    assert {r.term for r in M.scoped_terms(spark.createDataFrame(terms, "scope string, term string"), keep).collect()} == {w for _, w in terms} - {terms[0][1]}


def test_stripping_shuffles_no_text_and_equals_the_joins(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab.é漢😀") for _ in range(n))
    terms = spark.createDataFrame([(rng.choice(["x", "y", M.C.ALL_SCOPE, None]), word(rng.randrange(0, 7))) for _ in range(80)] + [("x", None)], "scope string, term string")
    docs = spark.createDataFrame([(i, word(rng.randrange(200)), rng.choice(["x", "y", "z", M.C.ALL_SCOPE, None])) for i in range(80)] + [(80, None, "x"), (81, "", None)], "id bigint, t string, s string").repartition(3)
    found = M.stripped(docs, "id", F.col("t"), F.col("s"), terms)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(M._stripped_by_joins(docs, "id", F.col("t"), F.col("s"), terms))
    assert key(M.stripped(docs, "id", F.col("t"), F.col("s"), terms.limit(0))) == key(docs.selectExpr("id", "coalesce(t, '') t", "0L"))
