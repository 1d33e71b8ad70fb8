"""Rounds over what is left: a batch of items is tried, and what was not attempted is tried again, each round by one claimant.

The items are a table with versions. A round reads the last version, claims it, and writes the next. A claim is a file that can be made only once, so
of several runs that read one version a single one goes on; the others wait for nothing and leave the round to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which what is left stays as it is.
MAX_ROUNDS = 15


class Versions:
    """Versions 0, 1, 2, ... of a table in a shared folder. A version is there once it is whole."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = jvm.Path
        self.files = jvm.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int | None:
        """The number of the last whole version; None if there is none."""
        n = None
        while self.files.exists(self.path(f"{self.folder}/{0 if n is None else n + 1}/_SUCCESS")):
            n = 0 if n is None else n + 1
        return n

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def write(self, items: DataFrame, version: int) -> None:
        items.write.mode("overwrite").parquet(f"{self.folder}/{version}")

    def claim(self, version: int) -> bool:
        """Whether the caller may make the version behind ``version``: true once, and only while that is the last one."""
        if self.last() != version:
            return False
        self.files.mkdirs(self.path(f"{self.folder}/claims"))
        return bool(self.files.createNewFile(self.path(f"{self.folder}/claims/{version}")))


def round_once(versions: Versions, attempt: Callable[[DataFrame], DataFrame], key: str = "url", rounds: int = MAX_ROUNDS) -> str:
    """One round: ``done`` if nothing is left or no round is, ``taken`` if another run has the claim, else ``went``.

    Items have ``attempted`` and ``round``. ``attempt`` gets those that were not attempted and returns them with both ``attempted`` and ``ok``, which
    replace theirs. A ``key`` must tell the items apart; it may be null.
    """
    n = versions.last()
    items = versions.read(n)
    left = items.where(~F.col("attempted"))
    if n >= rounds or left.isEmpty():
        return "done"
    if not versions.claim(n):
        return "taken"
    tried = attempt(left).select(F.col(key).alias("_k"), F.col("attempted").alias("_tried"), F.col("ok").alias("_ok"))
    d = items.join(tried, F.col(key).eqNullSafe(F.col("_k")) & ~F.col("attempted"), "left")
    new = F.coalesce("_tried", F.lit(False))
    d = d.withColumns({"attempted": F.col("attempted") | new, "ok": F.when(new, F.col("_ok")).otherwise(F.col("ok")), "round": F.when(new, n + 1).otherwise(F.col("round"))})
    versions.write(d.select(items.columns), n + 1)
    return "went"


def continued(items: DataFrame, folder: str, attempt: Callable[[DataFrame], DataFrame], key: str = "url", rounds: int = MAX_ROUNDS) -> DataFrame:
    """``items`` with ``attempted``, ``ok`` and ``round`` after as many rounds as it takes, ``rounds`` at most; null where an item was never attempted."""
    versions = Versions(items.sparkSession, folder)
    if versions.last() is None:
        versions.write(items.withColumns({"attempted": F.lit(False), "ok": F.lit(None).cast("boolean"), "round": F.lit(None).cast("int")}), 0)
    while round_once(versions, attempt, key, rounds) == "went":
        pass
    return versions.read(versions.last())


def research_urls(items: DataFrame, results: DataFrame, order: str, top: int = 50) -> DataFrame:
    """Distinct urls ``(url, place)`` that need another selector, ``top`` at most: failed items first, then results that fell back on the whole page.

    Null and empty urls are left out. Of equal ``order`` the smaller url comes first.
    """
    failed = items.where("status = 'failed'").select("url", F.lit(0).alias("_part"), F.col(order).alias("_o"))
    fallen = results.where("resolved_by = 'body_fallback'").select("url", F.lit(1).alias("_part"), F.col(order).alias("_o"))
    first = failed.union(fallen).where("url <> ''").groupBy("url").agg(F.min(F.struct("_part", "_o")).alias("_at"))
    return first.orderBy("_at", "url").limit(top).select("url", F.col("_at._part").alias("part"))
