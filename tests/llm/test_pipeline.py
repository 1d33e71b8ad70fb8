import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from millrace.llm import queries as Q
from millrace.llm.toxicity import Model, fit_on, score
from millrace.llm.words import ALNUM, words

from . import brute

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id for r in score(docs, fit_on(docs, spark.read.parquet(f"{D}/labels.parquet"))).where("score < 0.7").select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    has = lambda t: bool(brute.words(t))
    rows = [(i, left) for i, (n, gone, left) in brute.dedup_lines(rows).items() if not gone or has(left)]
    groups = brute.components(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not brute.contamination(t, items)[4]]
    want = {i: len(ids) for (i, _), ids in zip(rows, brute.encoded([t for _, t in rows], Q.tokenizer("byte_bpe_50k.json"), 0))}
    got = {}
    for r in P.run(spark, D).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, D).columns == P.COLUMNS


def test_null_and_repeated_keys_stage_by_stage(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    item = max((r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()), key=len)
    odd = lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    left = lambda stage, frame: sorted(((r.doc_id, r.text) for r in stage(spark, frame, D).collect()), key=repr)
    key = lambda *rows: sorted(rows, key=repr)

    # No text of the smallest tables is toxic, so one word is, by a model of its own.
    word = words(pa.array(["curse"]), ALNUM).hash
    monkeypatch.setattr(P, "fit_on", lambda *_: Model(word, np.array([9.0]), -5.0))
    toxic = [(None, "a curse"), (None, "clean"), (5, "a curse"), (5, "clean"), (5, "clean"), (None, None)]
    assert left(P.without_toxic, odd(*toxic)) == key((None, "clean"), (5, "clean"), (5, "clean"), (None, None))

    own = lambda x: " ".join(f"{x}{i}" for i in range(40))
    lines = [(None, own("a")), (5, own("a")), (5, own("b") + "\n" + own("a")), (6, own("c")), (6, own("c")), (7, own("c")), (None, None)]
    assert left(P.without_repeated_lines, odd(*lines)) == key((None, own("a")), (5, own("b")), (6, own("c")), (6, own("c")), (None, None))

    groups = [(None, own("a")), (None, own("a") + " x"), (5, own("b")), (5, own("b")), (5, own("c")), (4, own("c") + " x"), (None, own("b")), (8, ""), (8, ""), (None, None)]
    got = left(P.one_of_each_group, odd(*groups))
    assert len(got) == 6 and {i for i, t in got if t and t.startswith("a0 ")} == {None}
    assert [x for x in got if not (x[1] or "").startswith("a0 ")] == key((5, own("b")), (4, own("c") + " x"), (8, ""), (8, ""), (None, None))

    tests = [(None, item), (None, own("a")), (5, item), (5, own("a")), (5, own("a")), (None, None)]
    assert left(P.without_benchmark, odd(*tests)) == key((None, own("a")), (5, own("a")), (5, own("a")), (None, None))
    packed = P.packed(spark, odd(*tests), D).where("start = 0").collect()
    assert sorted((r.doc_id for r in packed), key=repr) == [5, 5, 5, None, None, None]
