"""Tables as Parquet folders or files, and the folder for tables in between."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all machines of a cluster share.

    Where it is not set, a folder of this machine's will do for Spark in one process, as in tests, and for nothing else.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = getattr(spark, "_millrace_folder", None) or "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark._millrace_folder = folder
    return folder.rstrip("/")
