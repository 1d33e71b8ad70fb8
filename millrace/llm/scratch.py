"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A table that several jobs read is written once as Parquet and read back. This cuts the lineage and
survives lost executors, as the files are not kept on the machine that made them.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_folder


class Scratch:
    """Tables of one run, each under a name of its own."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        # Workers of a session that was started elsewhere find this package too; on a cluster --py-files ships it.
        root = str(Path(__file__).resolve().parents[2])
        if root not in (known := spark.sparkContext.environment.get("PYTHONPATH", "")).split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the files."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later job reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
            if self.base.rpartition("/")[2] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
