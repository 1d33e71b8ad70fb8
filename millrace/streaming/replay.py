"""A table of events as a stream that comes in parts, with a stop and a restart from the checkpoint between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..sources.tables import shared_folder


def replay(events: DataFrame, at: str, parts: int, put: Callable[[DataFrame, int], None], through: Callable[[DataFrame], DataFrame] = lambda stream: stream, folder: str | None = None) -> None:
    """Sends ``events`` through ``through`` to ``put`` in ``parts`` batches by the time ``at``, each a run of its own with one checkpoint.

    Rows without a time come with the last part.
    """
    spark = events.sparkSession
    base = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    us = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = events.select(us.alias("us")).approxQuantile("us", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    part = sum((F.when(us < F.lit(c), 0).otherwise(1) for c in cuts), F.lit(0))
    for i in range(parts):
        events.where(part == i).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        writer: DataStreamWriter = through(stream).writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()


def appended(spark: SparkSession, run: Callable[[Callable[[DataFrame, int], None]], None], schema: str) -> DataFrame:
    """What ``run`` puts, as a table. A batch that comes again is written over itself."""
    base = f"{shared_folder(spark)}/told-{uuid.uuid4().hex[:12]}"
    run(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/{n}"))
    return spark.read.schema(schema).parquet(f"{base}/*")
