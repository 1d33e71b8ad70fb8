"""Tables of a report as texts of comma-separated values, each with its head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import csv_line, shown
from . import keywords as K


def as_csv(rows: DataFrame, head: list[str], order: list[str], cells: list[Column], bom: bool = False) -> DataFrame:
    """One row with ``csv``: the head and the lines of a report's ``rows``, some hundreds, in ``order``; the head alone if there are none."""
    lines = rows.select(F.struct(*order).alias("o"), csv_line(cells).alias("line")).agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "")
    return lines.select(F.concat(F.lit(C.BOM if bom else ""), csv_line([F.lit(h) for h in head]), body).alias("csv"))


def numeric_exports(docs: DataFrame, entities: DataFrame, n_docs: int | None = None, sentiment: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(name, csv)``: keywords, itemsets with rules, and entities behind a table of the sentiment.

    ``entities`` has ``(name, kind, salience, mentions)``, a report's few. Numbers have four places at most. Terms of an itemset stand in one cell.
    """
    words = K.top_keywords(docs, key, text).withColumn("rank", K._rank([F.desc("weight"), F.asc("term")]))
    words = as_csv(words, C.EXPORT_HEADS["tfidf"], ["rank"], [F.col("rank"), F.col("term"), shown(F.col("weight"))])
    sets = K.itemsets(docs, key, text, ranked=True).select(F.lit(0).alias("part"), "rank", F.lit("itemset").alias("type"), F.concat_ws(" + ", "a", "b").alias("of"), F.lit("").alias("then"), shown(F.col("support")).alias("support"), F.lit("").alias("confidence"), F.lit("").alias("lift"), F.col("n").alias("count"))
    rules = K.rules(docs, key, text, ranked=True).select(F.lit(1).alias("part"), "rank", F.lit("rule").alias("type"), F.col("if").alias("of"), "then", *[shown(F.col(c)).alias(c) for c in ("support", "confidence", "lift")], "count")
    both = as_csv(sets.union(rules), C.EXPORT_HEADS["association"], ["part", "rank"], [F.col(c) for c in ("type", "of", "then", "support", "confidence", "lift", "count")])
    told = entities.withColumn("rank", K._rank([F.desc("salience"), F.asc("name")]))
    told = as_csv(told, C.EXPORT_HEADS["entities"], ["rank"], [F.col("name"), F.col("kind"), shown(F.col("salience")), F.col("mentions")])
    mean = [("enabled", "True"), ("n_docs", "" if n_docs is None else str(n_docs)), ("avg_sentiment", "" if sentiment is None else repr(sentiment))]
    front = F.concat(*[csv_line([F.lit(x) for x in row]) for row in (C.EXPORT_HEADS["sentiment"], *mean)])
    told = told.select(F.concat(front, F.lit("\n"), "csv").alias("csv"))
    return reduce(DataFrame.union, [x.select(F.lit(name).alias("name"), "csv") for name, x in (("tfidf", words), ("association", both), ("entities", told))])
