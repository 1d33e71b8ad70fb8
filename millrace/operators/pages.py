"""The main text of pages, chosen among their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dom import blocks


def block_score(length: Column, quality: Column, link_share: Column, depth: Column, weight: Column, cjk: Column) -> Column:
    """0 for a block of less than 100 characters."""
    deep = 1 - F.abs(depth - 8) / F.greatest(depth, F.lit(8))
    score = 0.2 * length + 250 * quality + 125 * (1 - link_share) + 30 * deep + 40 * weight + 30 * cjk
    return F.when(length < 100, 0.0).otherwise(score)


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(key, resolved_by, tag, length, text)``, one per key.

    Candidates are blocks with three paragraphs or more than 300 characters that neither list other articles nor are a cookie banner. The best by
    score gives the text (``heuristic``); without one it is the whole page's (``body_fallback``), or ``failed`` if that is empty. Rows that repeat
    a key count as one page.
    """
    b = blocks(pages, key, html)
    quality = F.when(F.col("paragraphs") > 0, F.col("quality") / F.col("paragraphs")).otherwise(F.lit(0.0))
    links = F.least(F.lit(1.0), F.col("links") / F.greatest("length", F.lit(1)))
    score = block_score(F.col("length"), quality, links, F.col("depth"), F.col("weight"), F.col("cjk") / F.greatest("length", F.lit(1)))
    able = (F.col("node") > 0) & (F.col("tag") != "body") & ((F.col("paragraphs") >= 3) | (F.col("length") > 300)) & ~F.col("listed") & ~F.col("banner") & (score > 0)
    best = F.max(F.when(able, F.struct(score.alias("score"), (-F.col("node")).alias("first"), "tag", "begin", "length"))).alias("best")
    out = b.groupBy(key).agg(best, F.max("text").alias("whole"))
    text = F.when(F.col("best").isNotNull(), F.substring(F.col("whole"), (F.col("best.begin") + 1).cast("int"), F.col("best.length").cast("int"))).otherwise(F.col("whole"))
    by = F.when(F.col("best").isNotNull(), "heuristic").when(F.col("whole") != "", "body_fallback").otherwise("failed")
    return out.select(key, by.alias("resolved_by"), F.coalesce("best.tag", F.lit("page")).alias("tag"), F.length(text).cast("bigint").alias("length"), text.alias("text"))


def listing_page(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(key, articles, listing)``: five articles or more, or two to four of which none stands out in length, or
    more than five articles among the first twenty list items."""
    a = blocks(pages, key, html).groupBy(key).agg(
        F.count_if(F.col("tag") == "article").alias("articles"),
        F.max(F.when(F.col("tag") == "article", F.col("length"))).alias("top"),
        F.sum(F.when(F.col("tag") == "article", F.col("length"))).alias("all"),
        F.max("items").alias("items"),
    )
    rest = (F.col("all") - F.col("top")) / F.greatest(F.col("articles") - 1, F.lit(1))
    stands_out = F.col("top") > F.greatest(3 * rest, F.lit(500))
    return a.select(key, "articles", ((F.col("articles") >= 5) | ((F.col("articles") >= 2) & ~stands_out) | (F.col("items") > 5)).alias("listing"))
