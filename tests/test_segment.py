import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import keywords as K
from millrace.operators import segment as S
from millrace.plans import matching as P


def paths(run, words):
    """All ways to cut a run into dictionary words and single characters."""
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in words:
            for rest in paths(run[k:], words):
                yield [run[:k], *rest]


@pytest.mark.parametrize("seed", range(4))
def test_the_best_of_all_paths(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab漢字c") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(25)}
    d, total = S.Dictionary(words), sum(words.values())
    for _ in range(150):
        run = "".join(rng.choice("ab漢字cd") for _ in range(rng.randrange(12)))
        value = lambda p: sum(math.log(words.get(w, 1) / total) for w in p)
        best = max(map(value, paths(run, words)), default=0.0)
        ties = [p for p in paths(run, words) if value(p) > best - 1e-9]
        assert d.cut(run) == max(ties, key=lambda p: [len(w) for w in p])


def test_segmented_texts(spark):
    words = spark.createDataFrame([("無印良品", 5), ("無印", 3), ("良品", 3), ("的", 9), ("電動車", 2), (None, 3), ("", 3), ("bad", 0), ("good", -1), ("的", 1)], "word string, n int")
    d = S.dictionary(words)
    assert math.isclose(d.share["的"], math.log(10 / 23)) and "bad" not in d.share and "" not in d.share
    docs = spark.createDataFrame([(1, "無印良品的電動車，ABC 12 x_y"), (2, None), (3, ""), (1, "的" * 5000), (None, "無印良 品")], "id int, t string").withColumn("tokens", F.lit(1))
    got = {(r.id, tuple(r.tokens)) for r in S.segmented(docs, "id", "t", d).collect()}
    assert got == {(1, ("無印良品", "的", "電動車", "a", "b", "c", "x", "y")), (2, ()), (3, ()), (1, ("的",) * 5000), (None, ("無印", "良", "品"))}


def test_dictionaries_beyond_the_bound_stop_the_job(spark):
    with pytest.raises(ValueError):
        S.dictionary(spark.createDataFrame([("x" * (S.MAX_LENGTH + 1), 1)], "word string, n int"))


def test_content_tokens(spark):
    d = spark.createDataFrame([(["ab", "a", "12", "1,2", "a1", "--", "的車", "stop"],)], "t array<string>")
    assert d.select(S.content_tokens(F.col("t"), F.array(F.lit("stop"))).alias("t")).first().t == ["ab", "a1", "的車"]


def test_keywords_of_tokens_are_those_of_their_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = docs.select("doc_id", K.words(F.col("text")).alias("tokens"))
    assert K.top_keywords(tokens, "doc_id", "tokens").collect() == K.top_keywords(docs).collect()


def test_queries_of_documents(spark):
    d = "/root/testdata/sf0.001"
    words = P._dictionary(spark, d)
    rows = {r.doc_id: r.n for r in P.segmented_words(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").limit(20).collect():
        assert rows[r.doc_id] == sum(len(words.cut(x)) for x in re.findall(r"[^\W\d_]+", (r.text or "").lower()))
    assert P.segmented_keywords(spark, d).count() == 50
