"""A table that batches of a stream are merged into, each exactly once.

Rows are dealt to buckets by their key. A batch reads and writes only the buckets that it has rows of, as new versions that bear its number, and then one
commit names the version of every bucket. A batch whose number is committed is passed over, and what a batch wrote
before it failed is in no commit, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table. What the driver knows of a table are their versions.
BUCKETS = 64


def newest(old: Column, new: Column) -> Column:
    """Of two values, or structs in order of their fields, the greater; nulls give way."""
    return F.greatest(old, new)


def patched(old: Column, new: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(new, old)


def maps(old: Column, new: Column) -> Column:
    """Both maps in one; the new one's values win."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a)))


class MergedTable:
    """A table of ``schema`` in a folder that the cluster shares. ``keys`` tell its rows apart, null as good as any value.

    ``merge`` says for each other column how an old and a new value become one. A batch must have one row a key at most.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], merge: dict[str, Callable[[Column, Column], Column]], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.keys, self.merge, self.buckets = spark, folder.rstrip("/"), schema, keys, merge, buckets

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def committed(self) -> tuple[int, dict[int, int]]:
        """The last committed batch (-1 for none) and the version of each bucket that has one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return -1, {}
        log = self.spark.read.schema("batch long, versions map<int,long>").parquet(f"{self.folder}/commits/*")
        last = log.orderBy(F.desc("batch")).first()
        return (last.batch, last.versions) if last else (-1, {})

    def _read(self, versions: dict[int, int], of: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/batch-{v}/_bucket={b}" for b, v in versions.items() if of is None or b in of]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def read(self) -> DataFrame:
        return self._read(self.committed()[1])

    def put(self, batch: DataFrame, number: int) -> None:
        """Merges ``batch`` unless its ``number``, which grows from batch to batch, is committed. For ``foreachBatch``."""
        last, versions = self.committed()
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        values = F.struct(*self.merge)
        new = batch.select(bucket.alias("_bucket"), *self.keys, values.alias("_new")).repartition(self.buckets, "_bucket").persist()
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        old = self._read(versions, touched).select(bucket.alias("_bucket"), *self.keys, values.alias("_old"))
        # One shuffle by bucket serves the grouping and the writing, so a bucket is one file, however many tasks there are.
        both = old.unionByName(new, allowMissingColumns=True).repartition(self.buckets, "_bucket").groupBy("_bucket", *self.keys)
        both = both.agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("_old", "_new")])
        merged = both.select("_bucket", *self.keys, *[f(F.col(f"_old.{c}"), F.col(f"_new.{c}")).alias(c) for c, f in self.merge.items()])
        # What a failed attempt left here is overwritten.
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/batch-{number}")
        commit = self.spark.createDataFrame([(number, versions | {b: number for b in touched})], "batch long, versions map<int,long>")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{number:019d}")
        new.unpersist()
