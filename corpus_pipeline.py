"""A corpus pipeline of five stages, each a table of documents that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.data import read
from millrace.llm.jaccard import similar_documents
from millrace.llm.lines import dedup_lines
from millrace.llm.packing import pack
from millrace.llm.queries import tokenizer
from millrace.llm.scratch import Scratch
from millrace.llm.toxicity import THRESHOLD, fit_on, score
from millrace.llm.winnow import contamination

#: Columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def verdicts_by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, doc_id and a hash of the text. As a struct it equals itself also where its doc_id is null."""
    return docs.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("version")))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels of ``docs``, scores below its threshold.

    Each row goes or stays by its own text, also where its doc_id is null or repeated.
    """
    model, rows = fit_on(docs, read(spark, sf_dir, "labels")), verdicts_by_text(docs)
    rejected = score(rows, model, "row").where(F.col("score") >= THRESHOLD).select("row")
    return rows.join(rejected, "row", "left_anti").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines similar to an earlier one. What has no words left by that is gone; empty texts stay.

    Null doc_ids stand first. Rows that repeat doc_id and text are one document here, so all of them stay or go.
    """
    left = dedup_lines(docs).where(~F.coalesce("emptied", F.lit(False)))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the smallest doc_id; null doc_ids come last.

    Rows are grouped by their texts alone. Each row without words is a group of its own.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count() == 0:
        kept = similar_documents(docs).where("component_id = doc_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(COLUMNS)
    # Written with their numbers, which from then on are data and don't change.
    rows = Scratch(spark, "groups").table(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = rows.select("row", "doc_id").join(similar_documents(rows, "row").select("row", "component_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = found.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by benchmark items, each by its own text."""
    rows = verdicts_by_text(docs)
    found = contamination(rows, read(spark, sf_dir, "benchmark"), "row").where("contaminated").select("row")
    return rows.join(found, "row", "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each a document of its own, in sequences of 1024 tokens."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: The stages train, draw up packing patterns and follow links, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
