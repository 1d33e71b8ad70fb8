"""Keywords against plain Python, with ties, and the plans of large texts."""

import random
import time
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from millrace.functions import constants as C
from millrace.operators import keywords as K
from millrace.plans import queries as Q


def test_no_pattern_is_matched_within_a_lambda(spark):
    """The words of a text are cut once for each reading of it, and never again for each word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df, readings in ((K.term_counts(docs), 1), (K.weights(docs)[0], 2), (K.baskets(docs), 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == readings


def test_keywords_of_a_thousand_documents_take_seconds(spark):
    began = time.time()
    assert Q.QUERIES["tfidf_top_keywords"](spark, "/root/testdata/sf0.01").count() == C.TOP_KEYWORDS
    assert time.time() - began < 90


def test_pairs_and_rules_with_ties_equal_plain_counting(spark):
    rng = random.Random(2)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen"]
    texts = [(i * 3 % 41, " . ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(41)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    terms = {i: (w := t.replace(".", "").split()) and {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} for i, t in texts}
    often, held = Counter(), Counter()
    for _, t in texts:
        w = t.replace(".", "").split()
        often.update([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    held.update(x for own in terms.values() for x in own)
    known = sorted((x for x in often if held[x] <= C.MAX_DF * 41), key=lambda x: (-often[x], x))[: C.ASSOC_VOCABULARY]
    baskets = [sorted({*terms[i]} & {*known}) for i in sorted(terms) if {*terms[i]} & {*known}]
    one, pair = Counter(), Counter()
    for b in baskets:
        one.update(b)
        pair.update(combinations(b, 2))
    n = len(baskets)
    # A counter keeps the order in which it met its keys, and sorting keeps that of equals.
    frequent = sorted(((p, c) for p, c in pair.items() if c >= max(3, int(C.ASSOC_SUPPORT * n))), key=lambda x: -x[1])
    assert [(r.a, r.b, r.n) for r in K.itemsets(docs).collect()] == [(*p, c) for p, c in frequent[: C.ASSOC_SETS]]
    rules = [(x, y, round(c / one[x], 3), round(c / one[x] / (one[y] / n), 2)) for p, c in frequent for x, y in (p, p[::-1]) if c / one[x] >= C.ASSOC_CONFIDENCE and c / one[x] / (one[y] / n) > 1]
    rules.sort(key=lambda r: (-r[3], -r[2]))
    assert [(r["if"], r.then, r.confidence, r.lift) for r in K.rules(docs).collect()] == rules[: C.ASSOC_RULES] and len(rules) > C.ASSOC_RULES


def test_candidates_go_to_the_kind_that_comes_first(spark):
    rows = [(1, "b", "menu menu menu menu home"), (2, "b", "menu menu home the"), (3, "a", "home menu"), (4, "a", "home the menu"), (5, "m", "story the"), (6, None, "menu"), (7, "z", "seldom"), (8, "c", None), (9, "b", "kept brand"), (10, "b", "kept brand")]
    docs = spark.createDataFrame(rows, "doc_id bigint, kind string, text string")
    term = lambda *x: spark.createDataFrame([(w,) for w in x], "term string")
    found = K.filter_candidates(docs, "kind", "m", ["b", "a"], known=term("kept"), protected=term("brand"), filler=F.col("term") == "home")
    assert [tuple(r) for r in found.collect()] == [("a", "home", "填充", 1.0, 1.0, 0.0, 1.3), ("a", "menu", "需複查", 1.0, 1.0, 0.0, 1.0)]
    even = K.filter_candidates(docs.where("doc_id < 5"), "kind", "m", ["b", "a"])
    assert [tuple(r)[:3] for r in even.collect()] == [("b", "menu", "chrome"), ("b", "home", "需複查")]
    assert K.filter_candidates(docs.limit(0), "kind", "m", ["b"]).count() == 0


def _all_terms(docs):
    return K._each(K._terms(docs, "doc_id", "text"), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch):
    """The vocabulary equals that of all terms, and pairs with a rare word are not made; with too many words of one rank all terms are counted."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdeé漢" for b in "xyzw"]
    texts = [(i // 2 if i < 20 else i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60)))) for i in range(80)] + [(None, "ax ax"), (99, None), (98, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    n, terms = docs.count(), K._terms(docs, "doc_id", "text")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for size in (3, 20, 500):
        known = K.frequent_words(docs, "text", n, size)
        assert size == 500 or len(known) < len(words)
        found, _ = K._vocabulary_terms(docs, "doc_id", "text", size)
        vocabulary = K.vocabulary(terms, n, size)
        want = _all_terms(docs).join(vocabulary, "term").select("doc_id", "term", "df", "tf")
        assert key(found.groupBy("doc_id", "term", "df").agg(F.sum("tf").alias("tf"))) == key(want)
        with monkeypatch.context() as m:
            m.setattr(K, "FREQUENT", 2)
            assert K.frequent_words(docs, "text", n, size) is None
            found, _ = K._vocabulary_terms(docs, "doc_id", "text", size)
            assert key(found.groupBy("doc_id", "term", "df").agg(F.sum("tf").alias("tf"))) == key(want)
    coded = K.coded_terms(docs, "doc_id", "text", ["ax", "ay"]).where("doc_id is null").first()
    assert (coded.codes, coded.tf) == ([0, 2], [2, 1])
    assert K.top_keywords(docs.limit(0)).count() == 0


def test_totals_of_terms_shuffle_nothing_unless_keys_repeat(spark):
    docs = spark.createDataFrame([(1, "b a B a"), (2, None), (3, "x"), (None, "zu zu 1 ab"), (4, "")], "doc_id bigint, text string").withColumn("terms", F.lit("own"))
    found = K.term_totals(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = lambda d: sorted(map(tuple, K.term_counts(d).groupBy("doc_id").agg(F.count("*"), F.sum("tf"), F.max("term")).collect()), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want(docs) == [(None, 4, 5, "zu zu")]
    more = docs.union(docs.selectExpr("doc_id", "concat(text, ' new words') as text", "terms"))
    assert sorted(map(tuple, K.term_totals(more).collect()), key=repr) == want(more) and len(want(more)) == 4
