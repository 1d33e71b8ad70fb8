"""Removal of lines that are similar to an earlier one: an exact set-similarity join of line tokens.

Lines with equal token sets form a class, which stands where its first line stands. Tokens are ordered
by rarity; two similar sets share a token among their rarest ones (prefix filter). Pairs that meet
there must be close in size (length filter), and what follows the shared token must suffice for the
overlap (positional filter); a signature of 64 or 128 bits bounds the overlap further. What survives is verified on the whole sets.

A token of up to ``HOT`` prefixes lets all of these meet. Beyond that, every class first meets the earliest
class of the token alone; those that are not similar to it meet all earlier ones of a fitting size, so
that one token's rows are dealt by bands of sizes. A large group of variants of one line costs a few comparisons a line.

Everything is DataFrame functions. Two tables of fixed size, a number for each cell of hashed tokens and a byte for each cell
of hashed lines and documents, are written as tables of one row and read by scalar subqueries, so that plans do not carry them.
The second goes through the driver.

A filter on a computed column is planned below it and computes it once more, so what cuts texts is filtered by what is cheap alone.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hash cells in which tokens are counted, for their order alone. One number each.
CELLS, CELL_BITS = 1 << 18, 12
#: Prefixes of one token that all meet one another.
HOT = 512
#: Sets of more tokens have signatures of 128 bits, others of 64.
LONG = 64
#: Size of a set and position in it, in one number.
POS = 31
#: Bits of a line's number in a class number made of document and line.
LINE_BITS = 28
#: Hash cells that say which lines, of which documents, are verified. One byte each.
MAP_CELLS, MAP_ROWS = 1 << 21, 1 << 15
#: Sizes of similar sets lie in the same band or in neighbouring ones, if bands grow by a little more than sizes may.
BAND = 1.05
#: What a line with words has.
WORD = r"[^\x20\x09-\x0D]"
#: Documents have numbers below this.
MOST_DOCS = 1 << (63 - LINE_BITS)


_BITS = [bytes((x >> k) & 1 for k in range(8)) for x in range(256)]


def _lines(docs: DataFrame) -> DataFrame:
    """Rows ``(c, line)``: number and lower-cased text of each line."""
    lines = docs.select("o", F.posexplode(F.split(F.lower("text"), "\n")).alias("l", "line"))
    return lines.select(F.shiftleft("o", LINE_BITS).bitwiseOR(F.col("l").cast("bigint")).alias("c"), "line")


def _pieces(line: Column) -> Column:
    """Words of a line, and empty ones. Only lines with white space other than U+0020 are searched by a pattern."""
    other = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in "\t\v\f\r"])
    plain = F.when(other, F.regexp_replace(line, "[\t\x0b\f\r]", " ")).otherwise(line)
    return F.split(plain, " ")


def _hashes(line: Column) -> Column:
    return F.transform(F.array_remove(_pieces(line), ""), lambda w: F.xxhash64(w))


def _one_row(value: bytes, scratch: Scratch, name: str) -> Column:
    """A scalar subquery that gives ``value``."""
    return scratch.table(scratch.spark.createDataFrame([(value,)], "value binary"), name).scalar()


def rarity(docs: DataFrame) -> DataFrame:
    """One row with a number per cell whose highest byte grows with the number of words in it, over all words of all texts."""
    # Empty words only add to the cell of the empty one.
    word = _lines(docs).select(F.explode(_pieces(F.col("line"))).alias("w"))
    cell = F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1))
    # Every cell once more than its words, so that none is missing.
    counts = word.select(cell.alias("cell")).union(docs.sparkSession.range(CELLS).toDF("cell")).groupBy("cell").agg((F.count("*") - 1).alias("n"))
    value = lambda x: x.value
    level = F.shiftleft(F.least(F.lit(126), F.when(F.col("n") < 2, 1).otherwise(F.floor(4 * F.log2("n")))), 56)
    part = counts.select(F.shiftright("cell", CELL_BITS).alias("part"), F.struct("cell", level.alias("value")).alias("x"))
    part = part.groupBy("part").agg(F.transform(F.sort_array(F.collect_list("x")), value).alias("value"))
    return part.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), value)).alias("levels"))


def classes(docs: DataFrame, levels: Column, percent: int) -> DataFrame:
    """Rows ``(c, n, sign, more, prefix)``: first line of each token set, its size, signature and rarest tokens.

    A token is a number, its rarity in the highest byte and its hash below. The signature says for 64 hash groups of tokens whether their
    number is odd. For sets of more than ``LONG`` tokens ``more`` has that for half of the tokens, so that the other half is known too.
    """

    def token(h: Column) -> Column:
        # Never null, so that arrays are sorted as plain numbers.
        return F.coalesce(F.get("levels", h.bitwiseAND(F.lit(CELLS - 1))), F.lit(0)).bitwiseOR(F.shiftrightunsigned(h, 8))

    def parity(tokens: Column) -> Column:
        return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))))

    one = F.lit(1).cast("bigint")
    lines = _lines(docs).where(F.col("line").rlike(WORD)).select("c", _hashes(F.col("line")).alias("h"), levels.alias("levels"))
    lines = lines.select("c", F.sort_array(F.array_distinct(F.transform("h", token))).alias("t"))
    longest = F.size("t") - F.ceil(F.size("t") * percent / 100).cast("int") + 1
    more = F.when(F.size("t") > LONG, parity(F.filter("t", lambda h: h.bitwiseAND(F.lit(64)) == 0))).otherwise(0)
    lines = lines.select("c", F.size("t").cast("bigint").alias("n"), F.xxhash64("t").alias("h1"), F.hash("t").alias("h2"), parity(F.col("t")).alias("sign"), more.alias("more"), F.slice("t", F.lit(1), longest).alias("prefix"))
    # What follows from the set is part of the key, so that only numbers are aggregated, and copies before the shuffle too.
    same = ["h1", "h2", "n", "sign", "more", "prefix"]
    return lines.groupBy(*same).agg(F.min("c").alias("c")).select("c", "n", "sign", "more", "prefix")


def _close(percent: int) -> Column:
    """Length and positional filters for two sets that share a token, and the bound that their signatures give.

    Sets differ in as many tokens at least as their signatures do in bits.
    """
    n, pos, m, at = F.shiftright("np", POS), F.col("np").bitwiseAND(F.lit(2**POS - 1)), F.shiftright("np_b", POS), F.col("np_b").bitwiseAND(F.lit(2**POS - 1))
    left = F.least(n - pos, m - at)
    sign, more = F.col("sign").bitwiseXOR(F.col("sign_b")), F.col("more").bitwiseXOR(F.col("more_b"))
    apart = F.when(F.least(n, m) > LONG, F.bit_count(more) + F.bit_count(sign.bitwiseXOR(more))).otherwise(F.bit_count(sign))
    near = (n + m - apart) * (100 + percent) >= 2 * percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (left * (100 + percent) >= percent * (n + m)) & near


def _map_cell(*key: Column) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit(MAP_CELLS - 1)) + 1


def _map(ends: DataFrame) -> bytes:
    """A byte per cell of lines and documents: 1 where a line is that is wanted, or its document."""
    own = F.shiftright("c", LINE_BITS)
    bits = ends.select(F.explode(F.array(_map_cell(F.col("c")), _map_cell(own, F.lit(1)))).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(MAP_CELLS)
    for row in bits.collect():
        out[(row.part - 1) * MAP_ROWS : row.part * MAP_ROWS] = b"".join(_BITS[x] for x in row.bits)
    return bytes(out)


def verify(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows ``c``: of the pairs ``(c, c_b)``, c first, whose sets are similar, the class that stands later.

    Only lines that a pair may need, told by a map of fixed size, are cut into tokens again.
    """
    ends = scratch.table(pairs.select(F.explode(F.array("c", "c_b")).alias("c")).distinct(), "ends")
    wanted = _one_row(_map(ends), scratch, "map")
    there = lambda *key: F.substring(wanted, _map_cell(*key).cast("int"), F.lit(1)) == F.lit(b"\x01")
    lines = _lines(docs.where(there(F.col("o"), F.lit(1)))).where(there(F.col("c")))
    sets = lines.join(ends, "c", "left_semi").select("c", F.array_distinct(_hashes(F.col("line"))).alias("t"))
    sets = scratch.table(sets, "sets")
    both = pairs.join(sets, "c").join(sets.select(F.col("c").alias("c_b"), F.col("t").alias("t_b")), "c_b")
    shared = F.size(F.array_intersect("t", "t_b"))
    both = both.where(shared * (100 + percent) >= percent * (F.size("t") + F.size("t_b")))
    later = scratch.table(both.select(F.col("c_b").alias("c")).distinct(), "later")
    scratch.drop(sets, ends)
    return later


def _fitting(hot: DataFrame, later: DataFrame, other: list[Column], percent: int) -> DataFrame:
    """Pairs of close rows of one hot token. Its rows are dealt by bands of sizes that go together."""
    band = F.floor(F.log(F.shiftright("np", POS).cast("double")) / F.log(F.lit(BAND * 100 / percent)))
    probes = hot.join(later, "c", "left_anti").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    # The later of two is the probe, as the earlier may have gone.
    both = probes.join(hot.select("s", band.alias("band"), *other), ["s", "band"]).where("c_b < c").where(_close(percent))
    return both.select(F.col("c_b").alias("c"), F.col("c").alias("c_b")).distinct()


def similar_lines(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows ``(o, stay)``: the lines of each text that stay, being first of their class, and similar to no line before."""
    levels = scratch.table(rarity(docs), "levels").scalar()
    first = scratch.table(classes(docs, levels, percent), "classes")
    kept = ("c", "np", "sign", "more")
    other = [F.col(x).alias(f"{x}_b") for x in kept]
    rows = first.select("c", "n", "sign", "more", F.posexplode("prefix").alias("at", "s"))
    rows = rows.select("s", "c", (F.shiftleft("n", POS) + F.col("at")).alias("np"), "sign", "more")
    # Rarity tells which tokens may be in so many prefixes at all.
    loud = rows.where(F.col("s") >= F.lit(int(4 * log2(HOT + 1)) << 56))
    often = scratch.table(loud.groupBy("s").count().where(F.col("count") > HOT).select("s"), "often")
    hot = scratch.table(loud.join(often, "s"), "hot")
    lead = hot.groupBy("s").agg(F.min(F.struct(*kept)).alias("lead"))
    led = hot.join(lead.select("s", *[F.col("lead")[x].alias(f"{x}_b") for x in kept]), "s").where("c <> c_b").where(_close(percent))

    cold = rows.repartition("s").join(often, "s", "left_anti")
    both = cold.join(cold.select("s", *other), "s")
    met = both.where("c < c_b").where(_close(percent)).select("c", "c_b").union(led.select(F.col("c_b").alias("c"), F.col("c").alias("c_b")))
    pairs = scratch.table(met.distinct(), "met")
    # Each class first with the earliest that it met; a class that goes by that needs no other.
    nearest = scratch.table(pairs.groupBy("c_b").agg(F.min("c").alias("c")).select("c", "c_b"), "nearest")
    gone = verify(nearest, docs, percent, scratch)
    rest = pairs.join(gone.select(F.col("c").alias("c_b")), "c_b", "left_anti").select("c", "c_b")
    more = _fitting(hot, gone, other, percent)
    rest = scratch.table(rest.union(more).distinct().join(nearest, ["c", "c_b"], "left_anti"), "rest")
    later = gone.union(verify(rest, docs, percent, scratch))
    stay = first.select("c").join(later, "c", "left_anti")
    stay = stay.groupBy(F.shiftright("c", LINE_BITS).alias("o")).agg(F.collect_list(F.col("c").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")).alias("stay"))
    stay = scratch.table(stay, "stay")
    scratch.drop(first, often, hot, pairs, nearest, rest)
    return stay


def _numbered(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(o, v, text, number)`` of distinct ``(o, v)``, numbered without gaps in their order."""
    at = F.monotonically_increasing_id()
    placed = scratch.table(texts.dropDuplicates(["o", "v"]).sort("o", "v").withColumn("at", at), "placed")
    part = F.shiftright("at", 33)
    # One row for each task of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = placed.withColumn("part", part).join(base, "part")
    number = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return scratch.table(placed.select("o", "v", "text", number.alias("number")), "numbered")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``, and ``n_lines``, ``n_removed``, ``emptied`` added.

    Lines end at \\n. A line goes if an earlier one, in order of key and line, has a token set of
    ``percent`` Jaccard similarity or more, be that one removed or not. Lines without words stay. ``emptied``: the
    text had words and has none left. A null text stays null and has no lines. Rows that repeat key and text are one
    document; those that repeat the key alone are ordered by a hash of their text. Null keys stand first. Columns of the
    names added are replaced; other columns pass through, whatever their names. ``key`` must be a whole number.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    o, v = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))), F.coalesce(F.xxhash64(text), F.lit(0))
    texts = docs.select(o.alias("o"), v.alias("v"), F.col(text).alias("text"))
    counted = texts.groupBy("o").count().agg(F.max("count").alias("most"), F.min("o").alias("low"), F.max("o").alias("high")).first()
    plain = counted.most is None or (counted.most == 1 and counted.low >= 0 and counted.high < MOST_DOCS)
    texts = texts.where("text is not null")
    if plain:
        stay = similar_lines(texts.select("o", "text"), percent, scratch).withColumn("v", F.lit(0).cast("bigint"))
    else:
        numbered = _numbered(texts, scratch)
        stay = similar_lines(numbered.select(F.col("number").alias("o"), "text"), percent, scratch).withColumnRenamed("o", "number")
        stay = numbered.select("o", "v", "number").join(stay, "number").select("o", "v", "stay")

    # The input's columns travel in a struct, where no name meets one of ours.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), o.alias("o"), (F.lit(0).cast("bigint") if plain else v).alias("v"))
    both = row.join(stay, ["o", "v"], "left").withColumn("lines", F.split(F.col("row")[text], "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.get("lines", i).rlike(WORD))
    both = both.withColumn("blank", F.when(F.col("lines").isNotNull(), blank)).withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("blank") - F.size("stay"))
    whole = F.array_join(F.transform(F.sort_array(F.concat("blank", "stay")), lambda i: F.get("lines", i)), "\n")
    left = F.when(n_removed == 0, F.col("row")[text]).otherwise(whole)
    # No line with words stays, though the text has words. This is cheap to filter by.
    emptied = F.coalesce((F.size("stay") == 0) & F.col("row")[text].rlike(WORD), F.lit(False))
    added = {"n_lines": n_lines.cast("bigint"), "n_removed": n_removed.cast("bigint"), "emptied": emptied}
    passed = [(left if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in added]
    return both.select(*passed, *[x.alias(c) for c, x in added.items()])
