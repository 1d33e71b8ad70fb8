"""Keywords of a corpus: TF-IDF, association rules and words that belong to one kind of source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import constants as C
from ..functions.text import with_bigrams, words


def _cut(docs: DataFrame, text: str) -> Column:
    given = isinstance(docs.schema[text].dataType, ArrayType)
    return F.coalesce(text, F.array().cast("array<string>")) if given else words(F.col(text))


def _terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``(key, terms)``: words and pairs of neighbours of each document. ``text`` is a text, or an array of tokens that a segmenter made.

    A lambda over an array of one binds the words once, wherever the optimizer moves the expression.
    """
    return docs.select(F.col(key), F.get(F.transform(F.array(_cut(docs, text)), with_bigrams), F.lit(0)).alias("terms"))


def _each(terms: DataFrame, key: str, array: str | Column = "terms") -> DataFrame:
    """Rows ``(key, term)``. The outer form keeps the optimizer from cutting the words a second time to see whether there are any."""
    return terms.select(key, F.explode_outer(array).alias("term")).where("term is not null")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, term, tf)``; words and pairs of neighbours."""
    return _each(_terms(docs, key, text), key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_totals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_terms, n, last_term)``: distinct terms, all terms and the last one by name. Keys without terms have no row.

    Where no key repeats, each row tells this by itself and no term is shuffled.
    """
    if docs.groupBy(key).count().where("count > 1").limit(1).count():
        return term_counts(docs, key, text).groupBy(key).agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n"), F.max("term").alias("last_term"))
    each = F.transform(F.array(_cut(docs, text)), lambda w: F.get(F.transform(F.array(with_bigrams(w)), _totals), F.lit(0)))
    return docs.select(F.col(key), F.get(each, F.lit(0)).alias("x")).where("x.n > 0").select(key, "x.*")


def _totals(terms: Column) -> Column:
    return F.struct(F.size(F.array_distinct(terms)).cast("bigint").alias("n_terms"), F.size(terms).cast("bigint").alias("n"), F.array_max(terms).alias("last_term"))


def _term_frequencies(docs: DataFrame, by: list[str], terms: Column) -> DataFrame:
    """Rows ``(*by, term, df, tf)``: documents that have a term, and how often it stands in them.

    A document's terms are sorted in its row, where the first of each run tells it apart, so counting shuffles no rows by document.
    """
    none = F.array(F.lit(None).cast("string"))

    def with_before(t: Column) -> Column:
        return F.arrays_zip(t.alias("term"), F.concat(none, F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).alias("before"))

    ordered = F.get(F.transform(F.array(F.sort_array(terms)), with_before), F.lit(0))
    each = docs.select(*by, F.explode_outer(ordered).alias("x")).where("x.term is not null")
    first = F.when(F.col("x.before").eqNullSafe(F.col("x.term")), 0).otherwise(1)
    return each.groupBy(*by, F.col("x.term").alias("term")).agg(F.sum(first).alias("df"), F.count("*").alias("tf"))


def vocabulary(terms: DataFrame, n: int, size: int) -> DataFrame:
    """Rows ``(term, df)`` of the ``size`` terms that occur most often, but in at most ``MAX_DF`` of the ``n`` documents."""
    return _most_frequent(_term_frequencies(terms, [], F.col("terms")), n, size).select("term", "df")


def _most_frequent(found: DataFrame, n: int, size: int) -> DataFrame:
    able = found.where(F.col("df") <= C.MAX_DF * n if n > 1 else F.lit(True))
    return able.orderBy(F.desc("tf"), "term").limit(size)


#: Words that may make the terms of a vocabulary at most, and tokens that a task looks at together.
FREQUENT, TOGETHER = 1 << 13, 1 << 19


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut into pieces of about ``TOGETHER`` tokens, and of each token the row."""
    for b in batches:
        n = np.asarray(pa.compute.list_value_length(b["tokens"]), np.int64)
        piece = np.cumsum(n) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(n)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo), np.repeat(np.arange(hi - lo), n[lo:hi])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(word, df, tf)`` of pieces of a task's documents."""
    for b, row in _pieces(batches):
        words = b["tokens"].flatten().dictionary_encode()
        if len(words):
            at = np.asarray(words.indices.fill_null(-1), np.int64)
            row, at = row[at >= 0], at[at >= 0]
            held, size = np.unique(row * len(words.dictionary) + at) % len(words.dictionary), len(words.dictionary)
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(held, minlength=size)), pa.array(np.bincount(at, minlength=size))], names=["word", "df", "tf"])


def frequent_words(docs: DataFrame, text: str, n: int, size: int) -> list[str] | None:
    """The words of which the ``size`` most frequent terms consist, in order; None if these may be more than ``FREQUENT``.

    A pair stands nowhere more often than its words. So if ``size`` words that are not too common occur ``k`` times or more, no term with a
    rarer word is among the first.
    """
    found = docs.select(_cut(docs, text).alias("tokens")).mapInArrow(_counted, "word string, df bigint, tf bigint")
    found = found.groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    top = found.orderBy(F.desc("tf"), "word").limit(FREQUENT + 1).collect()
    able = [r.tf for r in top if n <= 1 or r.df <= C.MAX_DF * n]
    least = able[size - 1] if len(able) >= size else 0
    if len(top) > FREQUENT and top[-1].tf >= least:
        return None
    return sorted(r.word for r in top if r.tf >= least)


def coded_terms(docs: DataFrame, key: str, text: str, known: list[str]) -> DataFrame:
    """Rows ``(key, codes, tf)``, one per row of ``docs``: which words of ``known`` and pairs of these a document has, as numbers, and how often.

    A word's code is its place, and a pair's that of a square of all words behind them.
    """
    shared, m = docs.sparkSession.sparkContext.broadcast(known), len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        for b, row in _pieces(batches):
            at = np.asarray(pa.compute.index_in(b["tokens"].flatten(), value_set=words, skip_nulls=True).fill_null(-1), np.int64)
            both = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
            pairs = m + at[:-1][both] * m + at[1:][both]
            each = np.concatenate([row[at >= 0] * (m + m * m) + at[at >= 0], row[:-1][both] * (m + m * m) + pairs])
            each, tf = np.unique(each, return_counts=True)
            ends = pa.array(np.searchsorted(each, np.arange(b.num_rows + 1) * (m + m * m)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (each % max(m + m * m, 1), tf)]
            yield pa.RecordBatch.from_arrays([b["key"], *lists], names=["key", "codes", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), _cut(docs, text).alias("tokens"))
    return rows.mapInArrow(run, f"key {kind}, codes array<bigint>, tf array<bigint>").withColumnRenamed("key", key)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(code, df, tf)`` of a task's documents."""
    held: list[np.ndarray] = []

    def total() -> np.ndarray:
        code, df, tf = np.concatenate(held, axis=1)
        code, at = np.unique(code, return_inverse=True)
        return np.stack([code, *(np.bincount(at, x, len(code)).astype(np.int64) for x in (df, tf))])

    for b in batches:
        code, tf = (np.asarray(b[c].flatten(), np.int64) for c in ("codes", "tf"))
        held.append(np.stack([code, np.ones(len(code), np.int64), tf]))
        if sum(x.shape[1] for x in held) > 1 << 21:
            held[:] = [total()]
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, total())], names=["code", "df", "tf"])


def _vocabulary_terms(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, int]:
    """Rows ``(key, term, df, tf)`` of a vocabulary's terms, one for each row of ``docs`` and term that it holds; and the number of rows.

    Words are counted first. Then only pairs of frequent words are, as numbers, and the terms of each document meet the vocabulary as numbers.
    Tokens that are given must hold no spaces.
    """
    n = docs.count()
    known = frequent_words(docs, text, n, size)
    if known is None:
        terms = _terms(docs, key, text)
        found = vocabulary(terms, n, size)
        each = _each(terms, key).join(F.broadcast(found), "term")
        return each.select(key, "term", "df", F.lit(1).cast("bigint").alias("tf")), n
    m, spark = len(known), docs.sparkSession
    words = spark.createDataFrame(list(enumerate(known)), "i bigint, w string")
    counts = coded_terms(docs, key, text, known).select("codes", "tf").mapInArrow(_summed, "code bigint, df bigint, tf bigint")
    counts = counts.groupBy("code").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    pair = F.col("code") - m
    counts = counts.withColumns({"i": F.when(pair < 0, F.col("code")).otherwise(F.floor(pair / max(m, 1)))})
    counts = counts.withColumn("j", F.when(pair >= 0, pair - F.col("i") * m))
    counts = counts.join(F.broadcast(words), "i").join(F.broadcast(words.select(F.col("i").alias("j"), F.col("w").alias("v"))), "j", "left")
    found = _most_frequent(counts.select("code", F.concat_ws(" ", "w", "v").alias("term"), "df", "tf"), n, size).select("code", "term", "df")
    each = coded_terms(docs, key, text, known).select(key, F.explode(F.arrays_zip("codes", "tf")).alias("x")).select(key, F.col("x.codes").alias("code"), "x.tf")
    return each.join(F.broadcast(found), "code").select(key, "term", "df", "tf"), n


def weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows ``(key, term, weight)`` of the vocabulary's terms, each document of length 1; and the number of documents.

    The vocabulary has ``VOCABULARY`` rows at most and is broadcast; other terms leave before anything is shuffled.
    """
    each, n = _vocabulary_terms(docs, key, text, C.VOCABULARY)
    tf = each.groupBy(key, "term", "df").agg(F.sum("tf").alias("tf"))
    w = tf.withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight")), n


def top_keywords(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Terms of the greatest mean weight over all documents."""
    w, n = weights(docs, key, text)
    return w.groupBy("term").agg(F.round(F.sum("weight") / max(n, 1), 4).alias("weight")).orderBy(F.desc("weight"), "term").limit(C.TOP_KEYWORDS)


def article_keywords(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ten terms of the greatest weight of each document, with their rank."""
    w, _ = weights(docs, key, text)
    w = w.select(key, "term", F.round("weight", 4).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return w.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= C.PER_ARTICLE)


def baskets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, basket)``: which of the corpus's most frequent terms a document has, sorted. Documents without any have no row."""
    found, _ = _vocabulary_terms(docs, key, text, C.ASSOC_VOCABULARY)
    return found.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("basket"))


def frequent_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(a, b, n, n_a, n_b, total, first)`` of pairs of terms that stand together in enough documents. ``first`` is the first of these.

    Baskets, terms and pairs are counted at once; the counts, some hundreds, are read back by the broadcast sides.
    """
    none = F.lit(None).cast("string")
    one = F.transform("basket", lambda x: F.struct(x.alias("a"), none.alias("b")))
    rest = lambda x, i: F.transform(F.slice("basket", i + 2, F.size("basket")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pair = F.flatten(F.transform("basket", rest))
    whole = F.array(F.struct(none.alias("a"), none.alias("b")))
    counts = baskets(docs, key, text).select(key, F.explode(F.concat(whole, one, pair)).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    total = counts.where("a is null").select(F.col("n").alias("total"))
    out = counts.where("b is not null").crossJoin(F.broadcast(total))
    out = out.where((F.col("total") >= 4) & (F.col("n") >= F.greatest(F.lit(3), F.floor(C.ASSOC_SUPPORT * F.col("total")))))
    for side in "ab":
        single = counts.where("a is not null and b is null").select(F.col("a").alias(side), F.col("n").alias(f"n_{side}"))
        out = out.join(F.broadcast(single), side)
    return out


def _met() -> list[Column]:
    """Order of pairs of terms: by their number, then the one that was met first, as documents are read in order and their terms by name."""
    return [F.desc("n"), F.asc_nulls_first("first"), F.asc("a"), F.asc("b")]


def _rank(order: list) -> Column:
    """Places among some few rows, which one task puts in order."""
    return F.row_number().over(Window.orderBy(*order)).alias("rank")


def itemsets(docs: DataFrame, key: str = "doc_id", text: str = "text", ranked: bool = False) -> DataFrame:
    """Pairs of terms that stand together most often; ties go to the pair that was met first. With ``ranked`` their places too."""
    pairs = frequent_pairs(docs, key, text).orderBy(*_met()).limit(C.ASSOC_SETS)
    return pairs.select(*[_rank(_met())] * ranked, "a", "b", "n", F.round(F.col("n") / F.col("total"), C.SHARE_PLACES).alias("support"))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", ranked: bool = False) -> DataFrame:
    """Rules of the greatest lift, then confidence, both as they are shown; ties go to the pair that was met first, read forwards. With ``ranked`` their places too."""
    pairs = frequent_pairs(docs, key, text)
    side = lambda i, x, y: F.struct(F.lit(i).alias("side"), F.col(x).alias("if"), F.col(y).alias("then"), F.col(f"n_{x}").alias("x"), F.col(f"n_{y}").alias("y"))
    r = pairs.select("n", "total", "first", "a", "b", F.explode(F.array(side(0, "a", "b"), side(1, "b", "a"))).alias("r")).select("*", "r.*")
    r = r.withColumn("c", F.col("n") / F.col("x")).withColumn("l", F.col("c") / (F.col("y") / F.col("total"))).where((F.col("c") >= C.ASSOC_CONFIDENCE) & (F.col("l") > 1))
    share = lambda x: F.round(x, C.SHARE_PLACES)
    r = r.withColumns({"support": share(F.col("n") / F.col("total")), "confidence": share(F.col("c")), "lift": F.round("l", C.LIFT_PLACES)})
    order = [F.desc("lift"), F.desc("confidence"), *_met(), F.asc("side")]
    return r.orderBy(*order).limit(C.ASSOC_RULES).select(*[_rank(order)] * ranked, "if", "then", "support", "confidence", "lift", F.col("n").alias("count"))


def filter_candidates(
    docs: DataFrame,
    kind: str,
    baseline: str,
    order: list[str],
    key: str = "doc_id",
    text: str = "text",
    top: int = 60,
    known: DataFrame | None = None,
    protected: DataFrame | None = None,
    filler: Column | None = None,
) -> DataFrame:
    """Words that stand in most documents of one kind and in few of the baseline's: the chrome of that kind of site.

    A word belongs to the kind of the highest rate, of equals to the one that ``order`` has first; kinds that ``order`` lacks come
    last, by name. Terms of ``known`` (those that are filtered already) and of ``protected`` (names) are left out. ``filler`` tells of a
    ``term`` whether it only fills. Documents of a null kind are not counted.
    """
    size = docs.groupBy(kind).agg(F.count("*").alias("doc_n"))
    t = _term_frequencies(docs.where(F.col(kind).isNotNull()), [kind], words(F.col(text))).join(size, kind)
    t = t.select(kind, "term", "df", "doc_n", (F.col("df") / F.col("doc_n")).alias("rate"), (F.col("tf") / F.col("df")).alias("reps"))
    base = t.where(F.col(kind) == baseline).select("term", F.col("rate").alias("base"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    first = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("rate"), F.when(place > 0, place).otherwise(len(order) + 1), kind))
    best = t.where(F.col(kind) != baseline).withColumn("i", first).where("i = 1").join(base, "term", "left").fillna(0.0, ["base"])
    best = best.withColumn("disc", F.col("rate") - F.col("base")).where((F.col("rate") >= C.LEAST_RATE) & (F.col("disc") >= C.LEAST_GAP) & (F.col("doc_n") >= 2) & (F.col("df") >= 2))
    for gone in (known, protected):
        if gone is not None:
            best = best.join(gone.select("term"), "term", "left_anti")
    chrome, fills = F.col("reps") >= 3, F.lit(False) if filler is None else filler
    verdict = F.when(chrome, "chrome").when(fills, "填充").otherwise("需複查")
    score = F.col("disc") + F.when(chrome, F.col("reps") / 6).when(fills, C.FILLER).otherwise(0.0)
    shown = {"disc": (F.col("disc"), 2), "reps": (F.col("reps"), 1), "base_rate": (F.col("base"), 2), "score": (score, 3)}
    best = best.select(F.col(kind).alias("kind"), "term", verdict.alias("verdict"), *[F.round(x, places).alias(c) for c, (x, places) in shown.items()])
    return best.orderBy(F.desc("score"), "term").limit(top)


def cluster_keywords(docs: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text", top: int = C.CLUSTER_KEYWORDS) -> DataFrame:
    """Rows ``(cluster, term, weight, rank)``: the terms of the greatest summed weights among the keywords of a cluster's articles.

    ``members`` has ``(key, cluster)``. Of equal terms the one that was met first comes first, as articles are read in order and their keywords by rank. A
    cluster without keywords has no row; weights add up to four places.
    """
    each = article_keywords(docs, key, text).join(members.select(key, "cluster"), key)
    each = each.groupBy("cluster", "term").agg(F.round(F.sum("weight"), 4).alias("weight"), F.min(F.struct(F.col(key).alias("k"), F.col("rank").alias("r"))).alias("_met"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "_met"))
    return each.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("cluster", "term", "weight", "rank")
