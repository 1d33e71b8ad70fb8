"""Queries on the elements of pages: selectors, paths and texts by selectors. SQL can't parse pages; tests walk them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import selectors as S
from ..sources.nodes import nodes
from ..sources.tables import shared_folder, table
from .queries import query

#: Selectors that every page is asked for, the best first where a text is wanted.
SELECTORS = ["article p", "body > article", "div.ad", "article > p > b", "nav li a", "body *", "html body div p", "ul > li", "[class*=\"a\"]", "article", "main", "div", "#content .text"]


def _nodes(spark, d: str) -> DataFrame:
    """Pages are parsed once; what follows reads the rows."""
    found = nodes(table(spark, d, "pages").select("page_id", "html"))
    folder = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex[:12]}"
    found.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


@query()
def page_selector_matches(spark, d):
    found = S.matches(_nodes(spark, d), S.steps(spark, SELECTORS))
    return found.groupBy("page_id", "selector").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"))


@query()
def page_css_paths(spark, d):
    """Paths of all blocks and paragraphs."""
    return S.paths(_nodes(spark, d), F.col("tag").isin("p", "div", "article", "section", "main", "ul"))


@query()
def page_selected_text(spark, d):
    """Texts by the selectors of a page's host: a host prefers one, by a hash of its name, and then takes the list in order."""
    pages, rows = table(spark, d, "pages"), _nodes(spark, d)
    listed = F.array(*map(F.lit, SELECTORS))
    own = F.pmod(F.crc32(U.host(F.col("url"))), F.lit(len(SELECTORS))).cast("int")
    wanted = pages.select("page_id", F.posexplode(F.concat(F.array(F.get(listed, own)), listed)).alias("ord", "selector")).where(S.valid(F.col("selector")) | (F.col("selector") == "article"))
    return S.selected_texts(pages, rows, wanted, S.steps(spark, SELECTORS)).select("page_id", "selector", "node", F.length("text").cast("bigint").alias("length"), F.sha2("text", 256).alias("text_sha256"))
