"""Document quality by fixed rules and by how many documents of a host share each line.

Everything is DataFrame functions. Texts are read for counts and hashes of normalised lines, which
alone are shuffled to find boilerplate; a second reading meets what is to go and leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
#: A line is boilerplate in its host if at least so many documents of the host have it, however many the host has.
MIN_DOCS = 20
#: A document is depleted with fewer words left, or with less than half of its words.
MIN_WORDS, LEFT_PERCENT = 50, 50


def normalised(line: Column) -> Column:
    """A-Z in lower case, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules to ``(id, host, text)``, and ``lines`` as hash and number of words."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("id", "host", F.xxhash64("text").alias("version"), text.alias("t"))
    df = df.withColumn("w", F.transform(F.filter(F.split("t", SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn("worded", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("w"))
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    df = df.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), window)).otherwise(F.array().cast("array<bigint>")))

    def covered(placed: Column) -> Column:
        """Words in windows that stand next to an equal one once all are in order."""
        again = F.filter(placed, lambda x, i: (x["h"] == F.get(placed, i - 1)["h"]) | (x["h"] == F.get(placed, i + 1)["h"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        longer = lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), start, longer, lambda s: s["n"])

    # Most texts repeat no window, and their windows need no order.
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    covered = F.when(repeated, F.get(F.transform(F.array(placed), covered), F.lit(0))).otherwise(0)
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    return df.select(
        "id",
        "host",
        "version",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.transform(F.transform("worded", normalised), line).alias("lines"),
    )


def without(text: str, gone: str) -> Column:
    """``text`` without the lines whose normalised hash is in the array ``gone``; all of it where that is null."""
    stays = lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(gone, F.xxhash64(normalised(x))))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def quality(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    min_words: int = MIN_WORDS,
    left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """Base counts, ``n_boilerplate_words``, the verdict ``kept`` and ``text`` without boilerplate, one row per row of ``docs``.

    Lines end at \\n; those that stay are as they were. Rejected rows have their texts too. A null text has no words,
    fails the base rules and stays null; a null host is a host of its own. Documents of a line are counted once however
    often they have it, and rows that repeat a key are one document. Lines without words are ignored and stay.
    Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("host"), F.col(text).alias("text"))
    base = scratch.table(base_counts(docs), "base")
    # Rows that repeat key and text count once.
    rows = base.dropDuplicates(["id", "version", "host"]).select("id", "version", "host", F.explode("lines").alias("l")).select("id", "version", "host", "l.*")
    often = rows.groupBy("host", "h").agg(F.count_distinct(F.struct("id")).alias("line_docs")).where(F.col("line_docs") >= min_docs)
    often = scratch.table(often.select("host", "h"), "often")
    lost = rows.join(often, ["host", "h"]).groupBy("id", "version", "host").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("gone"))
    # Written, so that Spark knows its size when texts meet it: rows without boilerplate have no row here.
    lost = scratch.table(lost, "lost")
    same = F.expr("b.id <=> l.id and b.version = l.version and b.host = l.host")
    # Rows that repeat key, text and host have the same counts.
    df = base.drop("lines").dropDuplicates(["id", "version", "host"]).alias("b").join(lost.drop("gone").alias("l"), same, "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    boilerplate = F.coalesce("lost", F.lit(0)).cast("bigint")
    left = F.col("n_words") - F.col("n_boilerplate_words")
    df = df.select("b.*", boilerplate.alias("n_boilerplate_words"), failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (left >= min_words) & (100 * left >= left_percent * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boilerplate_words", "kept"]
    texts = docs.withColumn("version", F.xxhash64("text")).alias("b").join(lost.drop("lost").alias("l"), same, "left")
    texts = texts.select("b.id", "b.version", "b.host", without("text", "gone").alias("text"))
    both = texts.alias("d").join(df.withColumn("kept", kept).alias("b"), F.expr("d.id <=> b.id and d.version = b.version and d.host = b.host"))
    return both.select(F.col("d.id").alias(key), *counts, F.col("d.text").alias(text))
