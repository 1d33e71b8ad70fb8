"""Column functions on pages: what their head and their structured data say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import SPACE, clean_lines, strip

#: Named characters that are read back, the ampersand last.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
SCRIPT = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def unescaped(text: Column) -> Column:
    for name, character in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def meta(html: Column, attribute: str, name: str) -> Column:
    """Content of the first meta element of that name, whichever attribute comes first; empty if there is none."""
    named, content = f"{attribute}=[\"']{name}[\"']", "content=[\"']([^\"']*)[\"']"
    ahead = F.regexp_extract(html, f"(?is)<meta[^>]*{named}[^>]*{content}", 1)
    behind = F.regexp_extract(html, f"(?is)<meta[^>]*{content}[^>]*{named}", 1)
    return strip(unescaped(F.coalesce(F.when(ahead != "", ahead).otherwise(behind), F.lit(""))))


def description(html: Column) -> Column:
    own = meta(html, "property", "og:description")
    return F.when(own != "", own).otherwise(meta(html, "name", "description"))


def with_description(content: Column, html: Column) -> Column:
    """A short text behind the page's description, if that is not part of it."""
    text, said = F.coalesce(content, F.lit("")), description(html)
    lacks = (F.length(text) < C.LEAST_TEXT) & (said != "") & ~text.contains(said)
    return F.when(lacks, F.concat(said, F.lit("\n\n"), text)).otherwise(text)


def article_body(html: Column) -> Column:
    """Article of a page's structured data: the first of ``LEAST_BODY`` characters or more, with lines cleaned; else empty.

    A script holds one item or a list; the graph of the first item that has one stands for all of them. What is no JSON is passed over.
    """

    def items(raw: Column) -> Column:
        json = strip(raw)
        own = F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.startswith("{"), F.array(json))
        graphs = F.filter(F.transform(own, lambda x: F.get_json_object(x, "$['@graph']")), lambda g: g.isNotNull())
        return F.coalesce(F.when(F.size(graphs) > 0, F.from_json(F.get(graphs, F.lit(0)), "array<string>")).otherwise(own), F.array().cast("array<string>"))

    scripts = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))
    bodies = F.transform(F.flatten(F.transform(scripts, items)), lambda x: F.get_json_object(x, "$.articleBody"))
    return clean_lines(F.get(F.filter(bodies, lambda x: F.length(x) >= C.LEAST_BODY), F.lit(0)))


def best_of_srcset(srcset: Column) -> Column:
    """The url of the largest descriptor of a ``srcset``, of equals the last; null if there is none.

    Words are read one by one, as urls may hold commas: a word that ends in a comma is a candidate of its own, any other waits for what comes next,
    which is its descriptor if it looks like one. A candidate without a descriptor counts as 0. Nothing but the best is kept on the way.
    """
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("waits"), none.alias("best"), F.lit(-1.0).alias("score"))

    def taken(s: Column, url: Column, score: Column, waits: Column) -> Column:
        better = url.isNotNull() & (score >= s["score"])
        return F.struct(waits.alias("waits"), F.when(better, url).otherwise(s["best"]).alias("best"), F.when(better, score).otherwise(s["score"]).alias("score"))

    def fresh(s: Column, word: Column) -> Column:
        bare = F.left(word, F.length(word) - 1)
        alone = taken(s, F.when(bare != "", bare), F.lit(0.0), none)
        return F.when(word.endswith(","), alone).otherwise(F.struct(word.alias("waits"), s["best"].alias("best"), s["score"].alias("score")))

    def step(s: Column, word: Column) -> Column:
        size = F.regexp_extract(word, r"^([0-9]+(?:\.[0-9]+)?)[wx],*$", 1)
        described = taken(s, s["waits"], size.cast("double"), none)
        passed = F.get(F.transform(F.array(taken(s, s["waits"], F.lit(0.0), none)), lambda t: fresh(t, word)), F.lit(0))
        return F.when(s["waits"].isNull(), fresh(s, word)).when(size != "", described).otherwise(passed)

    words = F.filter(F.split(F.coalesce(srcset, F.lit("")), f"{SPACE}+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda s: taken(s, s["waits"], F.lit(0.0), none)["best"])


def best_image(srcset: Column, sources: Column, lazy: list[Column], src: Column) -> Column:
    """The best source of an image: of its ``srcset``, of each ``srcset`` of its picture's ``sources``, of attributes of late loading, else ``src``.

    What is empty or holds the image itself (``data:``) is passed over; null if nothing is left.
    """
    listed = F.concat(F.array(best_of_srcset(srcset)), F.transform(F.coalesce(sources, F.array().cast("array<string>")), best_of_srcset), F.array(*lazy, src))
    able = F.filter(F.transform(listed, lambda u: strip(u)), lambda u: u.isNotNull() & (u != "") & ~u.startswith("data:"))
    return F.get(able, F.lit(0))


def confidence(best: Column, second: Column, heading: Column, time: Column, paragraphs: Column) -> Column:
    """How surely a block is the article, from 0 to 1: its lead over the second, its own score, and its structure. A null second is none."""
    lead = F.when(best > 0, F.least(F.lit(1.0), F.greatest(best - F.coalesce(second, F.lit(0.0)), F.lit(0.0)) / best * 2)).otherwise(0.0)
    span = C.SURE_SCORE - C.LIKELY_SCORE
    own = F.when(best >= C.SURE_SCORE, 1.0).when(best >= C.LIKELY_SCORE, 0.7 + (best - C.LIKELY_SCORE) / span * 0.3).otherwise(best / C.LIKELY_SCORE * 0.7)
    built = 0.5 + F.when(heading, 0.2).otherwise(0.0) + F.when(time, 0.15).otherwise(0.0) + F.when(paragraphs >= 5, 0.15).otherwise(0.0)
    return 0.4 * lead + 0.3 * own + 0.3 * F.least(F.lit(1.0), built)
