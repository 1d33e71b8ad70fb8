"""CSS selectors over rows of elements, as joins: many selectors on many pages at once.

A selector is a list of steps, each an element by tag, id, classes and parts of class names, below the one before it or right below it. Steps
meet elements by equality of one thing they ask for: an id, a class or a tag. Which of these lie within an element of the step before is
told by the furthest end so far, as elements either hold one another or are apart. So no element meets another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import clean_lines, cookie_banner, has_any

_STEP = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:#[\w-]+|\.[\w-]+|\[class\*=\"[^\"]*\"\])*)")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[class\*=\"([^\"]*)\"\]")
SCHEMA = "selector string, step int, steps int, child boolean, handle string, tag string, id string, classes array<string>, parts array<string>"


def parsed(selector: str) -> list[tuple] | None:
    """Rows ``(step, steps, child, handle, tag, id, classes, parts)`` of a selector; None for what is not known here, as pseudo-classes."""
    out = []
    for child, token in re.findall(r"(>?)\s*([^\s>\[]+(?:\[[^\]]*\][^\s>\[]*)*|\[[^\]]*\][^\s>]*)", selector.strip()):
        m = _STEP.fullmatch(token)
        if not m:
            return None
        found = _PART.findall(m[2])
        ids, classes, parts = ([x for x in column if x] for column in zip(*found)) if found else ([], [], [])
        tag = (m[1] or "*").lower()
        handle = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag if tag != "*" else "*"
        out.append((bool(child), handle, None if tag == "*" else tag, ids[0] if ids else None, classes, parts))
        if len(set(ids)) > 1:
            return None
    rest = re.sub(r"[^\s>\[]+(?:\[[^\]]*\][^\s>\[]*)*|\[[^\]]*\][^\s>]*", "", selector)
    if not out or out[0][0] or rest.replace(">", "").strip() or rest.count(">") != sum(o[0] for o in out):
        return None
    return [(i, len(out), *o) for i, o in enumerate(out)]


def steps(spark: SparkSession, selectors: list[str]) -> DataFrame:
    """The steps of a list of selectors as a table; those that are not known are left out."""
    return spark.createDataFrame([(s, *row) for s in dict.fromkeys(selectors) for row in parsed(s) or ()], SCHEMA)


def matches(nodes: DataFrame, table: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows ``(key, selector, node)`` of all elements that each selector selects. ``table`` comes from :func:`steps`."""
    own = nodes.where("node >= 0").select(key, "node", "last", "parent", "tag", "id", "classes")
    handles = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag")), F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("#"), "id"))), F.transform("classes", lambda c: F.concat(F.lit("."), c))))
    used = table.select("handle").distinct()
    d = own.withColumn("handle", F.explode(handles)).join(F.broadcast(used), "handle", "left_semi").alias("n").join(F.broadcast(table).alias("s"), "handle")
    fits = (F.col("s.tag").isNull() | (F.col("s.tag") == F.col("n.tag"))) & (F.col("s.id").isNull() | F.col("s.id").eqNullSafe(F.col("n.id")))
    fits &= F.size(F.array_except("s.classes", "n.classes")) == 0
    fits &= F.forall("s.parts", lambda p: F.array_join("n.classes", " ").contains(p))
    d = d.where(fits).select(f"n.{key}", "n.node", "n.last", "n.parent", "s.selector", "s.step", "s.steps", "s.child")
    most = table.agg(F.max("steps")).first()[0] or 1
    held = d.where("step = 0")
    for i in range(1, most):
        lower = d.where(F.col("step") == i)
        # Elements of the step before, and those of this one, in order of begin.
        both = held.where(F.col("steps") > i).select(key, "selector", "node", "last", F.lit(None).cast("int").alias("parent"), F.lit(0).alias("low"), F.lit(None).cast("boolean").alias("child"), "steps")
        both = both.unionByName(lower.select(key, "selector", "node", "last", "parent", F.lit(1).alias("low"), "child", "steps"))
        before = Window.partitionBy(key, "selector").orderBy("node", F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.max(F.when(F.col("low") == 0, F.col("last"))).over(before) >= F.col("node")
        both = both.withColumn("_in", inside)
        right = held.select(key, "selector", F.col("node").alias("parent"), F.lit(True).alias("_right"))
        below = both.where("low = 1").join(right, [key, "selector", "parent"], "left")
        reached = below.where(F.when(F.col("child"), F.col("_right").isNotNull()).otherwise(F.coalesce("_in", F.lit(False))))
        reached = reached.select(key, "node", "last", "parent", "selector", F.lit(i).alias("step"), "steps", "child")
        held = held.where(F.col("steps") <= i).unionByName(reached)
    return held.select(key, "selector", "node").distinct()


def selected_texts(pages: DataFrame, nodes: DataFrame, wanted: DataFrame, table: DataFrame, key: str = "page_id", least: int = C.LEAST_SELECTED) -> DataFrame:
    """Rows ``(key, selector, node, text)``: for each page the first of its wanted selectors whose first element gives a whole text.

    ``wanted`` has ``(key, ord, selector)``. A text counts with ``least`` characters or more if it is no cookie banner and no list of other articles.
    Pages without such a text have no row.
    """
    first = matches(nodes, table, key).groupBy(key, "selector").agg(F.min("node").alias("node"))
    # Whether a text counts hangs on the element alone, so each is looked at once, by the best selector that gives it.
    d = wanted.select(key, "ord", "selector").join(first, [key, "selector"]).groupBy(key, "node").agg(F.min(F.struct("ord", "selector")).alias("s"))
    d = d.select(key, "node", "s.*").join(nodes.where("node >= 0").select(key, "node", "begin", "length"), [key, "node"])
    inner = nodes.where("node >= 0 and tag in ('li', 'article')").groupBy(key, "parent", "tag").agg(F.count("*").alias("n"))
    lists = inner.where(F.col("n") > F.when(F.col("tag") == "li", 5).otherwise(3)).select(key, F.col("parent").alias("node")).distinct()
    whole = nodes.where("node = -1").select(key, F.col("text").alias("_whole"))
    d = d.join(lists, [key, "node"], "left_anti").join(whole, key)
    text = clean_lines(F.substring(F.col("_whole"), (F.col("begin") + 1).cast("int"), F.col("length").cast("int")))
    counts = lambda t: (F.length(t) >= least) & ~F.exists(F.array(F.lower(t)), lambda low: cookie_banner(low) | has_any(low, C.LISTING_BLOCKS))
    # A lambda binds the text once, and the outer form keeps the optimizer from making it again for a filter.
    d = d.select(key, "ord", "selector", "node", F.explode_outer(F.filter(F.array(text), counts)).alias("text")).where("text is not null")
    return d.groupBy(key).agg(F.min(F.struct("ord", "selector", "node", "text")).alias("x")).select(key, "x.selector", "x.node", "x.text")


def _named(tag: Column, id: Column, classes: Column) -> Column:
    marks = F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(F.slice(classes, 1, 3), "."))).otherwise("")
    return F.concat(tag, F.when(id.isNotNull(), F.concat(F.lit("#"), id)).otherwise(""), marks)


def paths(nodes: DataFrame, of: Column, key: str = "page_id") -> DataFrame:
    """Rows ``(key, node, path)``: the path from the root of the elements for which ``of`` holds, each with its id and its first three classes.

    The outermost element, ``html``, is left out, and of deeper paths the nearest 21 levels stay. Each step up is one join by the parent's number, as many
    as the deepest path needs.
    """
    own = nodes.where("node >= 0").select(key, "node", "parent", "tag", _named(F.col("tag"), F.col("id"), F.col("classes")).alias("name"), of.alias("_of"))
    up = own.where("tag <> 'html'").select(key, F.col("node").alias("at"), F.col("parent").alias("to"), F.col("name").alias("above"))
    d = own.where("_of and tag <> 'html'").select(key, "node", "parent", F.col("name").alias("path"))
    deepest = min(nodes.agg(F.max("depth")).first()[0] or 0, C.PATH_LEVELS)
    for _ in range(deepest):
        d = d.join(up, (d[key] == up[key]) & (d["parent"] == up["at"]), "left").select(d[key], "node", F.col("to").alias("parent"), F.concat_ws(" > ", "above", "path").alias("path"))
    return d.select(key, "node", "path")


def normalised(selector: Column) -> Column:
    """A selector as it may be kept for a site: no positions, a class with a hash by its name alone; empty if it has nothing that lasts.

    Ids with three digits in a row and classes of style frameworks stand for one page or one build only.
    """
    s = F.trim(F.regexp_replace(F.trim(F.coalesce(selector, F.lit(""))), r":nth-(?:child|of-type)\([^)]*\)", ""))
    classes = F.regexp_extract_all(s, F.lit(r"\.([A-Za-z_][\w-]*)"), F.lit(1))
    gone = s.rlike(r"#[A-Za-z_][\w-]*\d{3,}") | F.exists(classes, lambda c: c.rlike(r"(?i)^(?:css|sc|emotion)-[A-Za-z0-9]{4,}$"))
    hashed = r"\.([A-Z][A-Za-z0-9]*)-(?=[A-Za-z0-9]{5,}(?![\w-]))(?=[A-Za-z0-9]*\d|[A-Za-z0-9]*[a-z][A-Za-z0-9]*[A-Z]|[A-Za-z0-9]*[A-Z][A-Za-z0-9]*[a-z])[A-Za-z0-9]+"
    return F.when(gone, "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(s, hashed, r'[class*="$1"]'), r"\s+", " ")))


def valid(selector: Column) -> Column:
    """Whether a selector is narrow enough to be kept: not empty or over 200 characters, no bare wide tag, no id of one page."""
    s = F.lower(F.trim(F.coalesce(selector, F.lit(""))))
    return (s != "") & (F.length(s) <= 200) & ~s.isin(C.WIDE_SELECTORS) & ~s.rlike(r"#[a-z_][\w-]*\d{3,}")
