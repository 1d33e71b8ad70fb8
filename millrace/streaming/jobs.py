"""State of jobs over a stream of their events: the first final status stays, whatever comes later."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

ORDER = ["ts", "event_id"]


def _first_final(status: str, final: list[str]) -> Column:
    at = F.struct(*ORDER)
    return F.coalesce(F.min_by(F.when(F.col(status).isin(final), F.col(status)), F.when(F.col(status).isin(final), at)), F.max_by(status, at))


def final_status(events: DataFrame, job: str, status: str, final: list[str]) -> DataFrame:
    """Rows ``(job, status)``: the earliest of the ``final`` statuses, else the latest status. Also for streams, in complete mode."""
    return events.groupBy(F.col(job).alias("job")).agg(_first_final(status, final).alias("status"))


def run_job_state(spark: SparkSession, path: str, job: str, status: str, final: list[str]) -> DataFrame:
    """Read the files of ``path`` as a stream to its present end and return the state of all jobs.

    Each trigger writes the whole state under its own number, in the shared folder; the last one counts.
    """
    base = f"{shared_folder(spark)}/job-state-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path if not path.endswith(".parquet") else path.rpartition("/")[0] + "/events.parquet*")
    written: list[int] = []

    def put(state: DataFrame, epoch: int) -> None:
        state.write.mode("overwrite").parquet(f"{base}/state/{epoch}")
        written.append(epoch)

    stream = final_status(events, job, status, final).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/state/{max(written)}")
