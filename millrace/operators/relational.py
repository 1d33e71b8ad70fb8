"""Bookkeeping of datasets, jobs and usage as joins, windows and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key, all columns kept. Null keys are a key of their own; of rows that tie in ``order`` any one stays."""
    return latest(df, by, order, 1)


def latest(df: DataFrame, by: str | list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, so the last ones if that falls; all columns kept. Null keys are a key of their own."""
    i = free(df, "_i")
    keys = [by] if isinstance(by, str) else by
    return df.withColumn(i, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(i) <= n).drop(i)


def append_new(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """``old``, and of ``new`` the first row of each key that ``old`` lacks."""
    return old.unionByName(first_of(new, [key], order).join(old.select(key), key, "left_anti").select(old.columns))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new``, and the rows of ``old`` whose key it lacks."""
    return old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows ``(label, n, percent)``; null and empty labels are left out and not counted. An empty table has no rows."""
    own = df.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "")).groupBy(label).agg(F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("_all")))).select(label, "n", F.bround(100 * F.col("n") / F.col("_all")).cast("bigint").alias("percent"))


def runs_of_failures(events: DataFrame, by: str, order: list, failed: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive failures: ``(by, run, n)``. Null is no failure, a null key is one of its own, and ``order`` should leave no ties."""
    w = Window.partitionBy(by).orderBy(*order)
    bad = F.coalesce(failed, F.lit(False))
    e = events.select(by, bad.alias("_f"), F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return e.where("_f").groupBy(by, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_range``: one of as many ranges of the number ``order`` as there are shuffle partitions, cut at quantiles.

    Equal numbers are in one range, nulls in the last.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []

    def part(lo: int, hi: int) -> Column:
        """How many of ``bounds[lo:hi]``, and those before, are at most ``order``."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) < F.lit(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return df.withColumn("_range", F.when(F.col(order).isNull(), len(bounds)).otherwise(part(0, len(bounds))))


def numbered(df: DataFrame, order: str, name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with ``name``: numbers without gaps from ``start`` in order of ``order``, a number; nulls come last, ties in any order.

    Each range is numbered by itself, behind all rows of the ranges before it.
    """
    d = in_ranges(df, order)
    # One row a range, so that one task can add them up.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = d.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last(order)))
    return d.withColumn("_own", own).join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_before") + F.col("_own") - 1 + start).alias(name))


def append_numbered(old: DataFrame, new: DataFrame, order: str, seq: str = "seq") -> DataFrame:
    """``old``, and ``new`` with the numbers that follow the largest of ``old``."""
    top = old.agg(F.max(seq).alias("top")).first().top
    return old.unionByName(numbered(new, order, seq, 0 if top is None else top + 1))


def attempts(items: DataFrame, by: str, order: list, failed: Column, seconds: Column, least: int = 3, limit: float | None = None) -> DataFrame:
    """``items`` with ``attempted``: false behind ``least`` failures in a row, and where what went before took more than ``limit``."""
    w = Window.partitionBy(by).orderBy(*order)
    before, near = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1 - least, 0)
    hung = (F.min(F.when(failed, 1).otherwise(0)).over(near) == 1) & (F.count("*").over(near) == least)
    h, took = free(items, "_hung"), free(items, "_took")
    d = items.withColumn(h, hung.cast("int")).withColumn(took, F.coalesce(F.sum(seconds).over(before), F.lit(0)))
    ok = F.coalesce(F.max(h).over(before), F.lit(0)) == 0
    return d.withColumn("attempted", ok if limit is None else ok & (F.col(took) <= limit)).drop(h, took)


def following(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the next row in order of ``order``, a number; null in the last row.

    Rows that repeat ``order`` stand in order of ``value``, nulls last. Of each range of ``order`` its first row goes to the one before.
    """
    by = [F.asc_nulls_last(order), F.asc_nulls_last(value)]
    d = in_ranges(df, order)
    w = Window.partitionBy("_range").orderBy(*by)
    firsts = d.groupBy("_range").agg(F.min(F.struct(F.col(order).isNull(), order, F.col(value).isNull(), F.col(value).alias("_first")))["_first"].alias("_first"))
    # One row a range, so that one task can put them in order.
    firsts = firsts.select((F.lead("_range", -1).over(Window.orderBy("_range"))).alias("_range"), "_first").where("_range is not null")
    d = d.withColumns({"_next": F.lead(value).over(w), "_left": F.count("*").over(w.rowsBetween(1, 1))})
    d = d.join(F.broadcast(firsts), "_range", "left")
    return d.withColumn(name, F.when(F.col("_left") == 0, F.col("_first")).otherwise(F.col("_next"))).select(*df.columns, name)


def chunk_progress(items: DataFrame, job: str, position: Column, size: int, done: Column) -> DataFrame:
    """Chunks of ``size`` items of each job, how many are done, and progress in percent (99 until all are). An item of unknown state is not done; a job without items has no row."""
    c = items.withColumn("_c", F.floor(position / size)).groupBy(job, "_c").agg(F.min(F.coalesce(done, F.lit(False))).alias("_d"))
    c = c.groupBy(job).agg(F.count("*").alias("chunks"), F.count_if("_d").alias("done"))
    return c.withColumn("progress", F.when(F.col("done") == F.col("chunks"), 100).otherwise(F.least(F.lit(99), F.floor(100 * F.col("done") / F.col("chunks")))).cast("bigint"))


def positional(rows: DataFrame, answers: DataFrame, by: list[str], place: str, index: str, order: list[str], answer: str) -> DataFrame:
    """``rows`` with ``answer`` and ``failed``: what was answered to the row of that number in its batch.

    ``rows`` are numbered from 1 by ``place`` within ``by``. Of several answers of one ``index`` the first in ``order`` counts, and an index below 1 or beyond
    the batch none. A row without an answer, or with a null one, has failed. Rows of a null batch have none.
    """
    first = F.min(F.struct(*[F.col(c) for c in order], F.col(answer).alias("_answer")))["_answer"]
    found = answers.where(F.col(index) >= 1).groupBy(*by, F.col(index).alias(place)).agg(first.alias("answer"))
    return rows.join(found, [*by, place], "left").withColumn("failed", F.col("answer").isNull())


def sampled(df: DataFrame, by: list[str], key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows of each group, or all if there are fewer: those of the smallest keyed hash, whatever the partitions. All columns are kept.

    Spark cuts each partition to ``n`` rows a group before it shuffles. Rows of equal ``key`` have equal hashes, of which any come first; null keys come last.
    """
    own = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))
    return latest(df, by, [F.asc_nulls_last(own), F.asc_nulls_last(key)], n)


def best_two(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """Rows ``(*by, key, best, second)``: the row of the greatest ``score`` of each group and the next score; null if it is alone. Ties go to the smaller key, null scores don't count."""
    first = latest(df.where(F.col(score).isNotNull()).select(*by, key, score), by, [F.desc(score), F.asc_nulls_last(key)], 2)
    both = first.groupBy(*by).agg(F.max_by(F.col(key), F.struct(F.col(score), (-F.col(key)).alias("k"))).alias(key), F.max(score).alias("best"), F.min(score).alias("_low"), F.count("*").alias("_n"))
    return both.select(*by, key, "best", F.when(F.col("_n") > 1, F.col("_low")).alias("second"))
