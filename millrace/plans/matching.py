"""Queries that look for many strings at once, with their SQL: site templates, terms that are stripped, segmentation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import urls as U
from ..operators import keywords as K
from ..operators import patterns as M
from ..operators import segment as S
from ..sources.tables import shared_folder, table
from .queries import _PART, query

# Site templates

#: Templates from the table of pages: one for each host, with three indicators: the host, its first label, and the label before a path.
_TEMPLATES = f"""
h AS (SELECT lower({_PART("url", 2)}) AS host, min(page_id) AS ord FROM pages GROUP BY 1 HAVING host <> ''),
t AS (SELECT host AS name, ord, unnest([host, split_part(host, '.', 1), split_part(host, '.', 2) || '/']) AS indicator FROM h)
"""


def _templates(spark: SparkSession, d: str) -> DataFrame:
    host = U.host(F.col("url"))
    hosts = table(spark, d, "pages").groupBy(host.alias("name")).agg(F.min("page_id").alias("ord")).where("name <> ''")
    label = F.split("name", r"\.")
    return hosts.select("name", "ord", F.explode(F.array("name", label[0], F.concat(F.coalesce(F.get(label, 1), F.lit("")), F.lit("/")))).alias("indicator"))


@query(f"""WITH {_TEMPLATES},
m AS (SELECT page_id, name, ord, max_by(indicator, (length(indicator), indicator)) AS indicator FROM pages JOIN t ON indicator <> '' AND contains(lower(url), indicator) GROUP BY page_id, name, ord)
SELECT page_id, name, indicator FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN contains(indicator, '.') THEN {C.DOTTED} ELSE 0 END + length(indicator) DESC, ord, name) AS i FROM m) WHERE i = 1""")
def site_template_match(spark, d):
    return M.best_template(table(spark, d, "pages"), "page_id", "url", _templates(spark, d))


@query(f"WITH {_TEMPLATES} SELECT page_id, EXISTS (SELECT 1 FROM t WHERE indicator <> '' AND NOT contains(indicator, '.') AND contains(lower(url), indicator)) AS known FROM pages")
def known_container(spark, d):
    """Whether any indicator without a dot is part of a url; one template's or another's is all the same."""
    pages = table(spark, d, "pages").select("page_id", F.lower("url").alias("u"))
    found = M.occurrences(pages, "page_id", "u", _templates(spark, d).where(~F.col("indicator").contains(".")), "indicator")
    return pages.join(found.select("page_id").distinct().withColumn("k", F.lit(True)), "page_id", "left").select("page_id", F.coalesce("k", F.lit(False)).alias("known"))


# Terms by scope

#: The most frequent words of each language are its terms, those of any source at that the words of benchmark items; what most turns of conversations hold is kept.
_SCOPED = rf"""
w AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{2,}}')) AS term FROM documents),
b AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{2,}}')) AS term FROM benchmark),
v AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{2,}}')) AS term FROM conversations),
f AS (SELECT lang AS scope, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS i FROM w WHERE lang IS NOT NULL GROUP BY lang, term),
g AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS i FROM b GROUP BY term),
k AS (SELECT term FROM v GROUP BY term ORDER BY count(*) DESC, term LIMIT 20),
s AS (SELECT scope, term FROM f WHERE i <= 60 UNION SELECT '{C.ALL_SCOPE}', term FROM g WHERE i <= 20),
t AS (SELECT * FROM s WHERE term NOT IN (SELECT term FROM k))
"""


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    each = lambda name, *by: table(spark, d, name).select(*by, F.explode(T.words(F.col("text"))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))
    first = lambda df, n: df.orderBy(F.desc("n"), "term").limit(n).select("term")
    own = each("documents", "lang").where("lang is not null").groupBy("lang").agg(F.max_by("term", "n").alias("_"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))).alias("t"))
    own = own.select(F.col("lang").alias("scope"), F.explode(F.slice("t", 1, 60)).alias("x")).select("scope", "x.term")
    everywhere = first(each("benchmark"), 20).select(F.lit(C.ALL_SCOPE).alias("scope"), "term")
    return M.scoped_terms(own.union(everywhere), first(each("conversations"), 20))


@query(f"WITH {_SCOPED} SELECT scope, term FROM t")
def scoped_stop_terms(spark, d):
    return _scoped(spark, d)


@query(rf"""WITH {_SCOPED},
d AS (SELECT doc_id, lang, regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '(?i)https?://\S+|www\.\S+', ' ', 'g') AS x FROM documents),
h AS (SELECT d.doc_id, t.term FROM d JOIN t ON (t.scope = d.lang OR t.scope = '{C.ALL_SCOPE}') AND contains(x, t.term)),
p AS (SELECT doc_id, count(DISTINCT term) AS n, string_agg(DISTINCT term, '|' ORDER BY term DESC) AS u, array_to_string(list_transform(list_sort(list_distinct(list((-length(term), term)))), lambda z: z[2]), '|') AS p FROM h GROUP BY doc_id)
SELECT doc_id, sha256(CASE WHEN p IS NULL THEN x ELSE regexp_replace(x, p, ' ', 'g') END) AS text_sha256, coalesce(n, 0)::BIGINT AS n_terms FROM d LEFT JOIN p USING (doc_id)""")
def scoped_terms_stripped(spark, d):
    docs = table(spark, d, "documents")
    # The source stands for the title here, and the language for the kind of source.
    text = M.without_urls(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    out = M.stripped(docs, "doc_id", text, F.col("lang"), _scoped(spark, d))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_terms")


# Segmentation

#: Words of the dictionary, by how many benchmark items and turns of conversations have them.
DICTIONARY = 5000


def _dictionary(spark: SparkSession, d: str) -> S.Dictionary:
    both = table(spark, d, "benchmark").select("text").union(table(spark, d, "conversations").select("text"))
    each = both.select(F.explode(T.words(F.col("text"))).alias("word")).where(F.length("word") <= S.MAX_LENGTH)
    return S.dictionary(each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(DICTIONARY))


@query()
def segmented_words(spark, d):
    """Words of documents by the dictionary of what benchmark and conversations hold: their number and a digest of them in order."""
    docs = table(spark, d, "documents")
    tokens = S.segmented(docs, "doc_id", "text", _dictionary(spark, d))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query()
def segmented_keywords(spark, d):
    """Keywords of documents whose words come from the dictionary, without the terms of any source."""
    docs = table(spark, d, "documents")
    stop = [r.term for r in _scoped(spark, d).where(F.col("scope") == C.ALL_SCOPE).select("term").collect()]
    tokens = S.segmented(docs, "doc_id", "text", _dictionary(spark, d)).withColumn("tokens", S.content_tokens(F.col("tokens"), F.array(*map(F.lit, stop)).cast("array<string>")))
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    # Written, as the vocabulary and the weights each read them.
    tokens.write.parquet(folder)
    return K.top_keywords(spark.read.schema(tokens.schema).parquet(folder), "doc_id", "tokens")
