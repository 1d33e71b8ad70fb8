"""Queries over the table of events as a stream in four parts, with restarts, each with the SQL of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import continued as N
from ..operators import relational as R
from ..sources.tables import shared_folder, table
from ..streaming.replay import appended, replay
from ..streaming.sink import MergedTable, newest
from ..streaming.state import DailyQuota, FailureCounter, Fold, Reaper, StatusMachine, follow
from .queries import query

#: Parts of the stream, minutes that events may be late, calls a day, and hours after which a silent job has failed.
PARTS, LATE, CALLS, FEW_CALLS, SILENT = 4, 10, 5, 2, 6

#: Up to the last watermark, which is in milliseconds, all is told.
_CUT = f"c AS (SELECT (epoch_ms(max(ts)) - {LATE * 60_000}) * 1000 AS c FROM events)"


def _told(spark, d: str, value: Column, fold: Fold) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id", value.alias("value"))

    def through(stream: DataFrame) -> DataFrame:
        return follow(stream, "user_id", "ts", "event_id", F.col("value"), fold, f"{LATE} minutes")

    kind = events.schema["user_id"].dataType.simpleString()
    return appended(spark, lambda put: replay(events, "ts", PARTS, put, through), f"user_id {kind}, at timestamp, event long, told string").withColumn("at_us", F.unix_micros("at"))


@query(f"""WITH {_CUT}, e AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_id, CASE WHEN i <= CASE WHEN user_id % 3 = 0 THEN {FEW_CALLS} ELSE {CALLS} END THEN 'allowed' ELSE 'refused' END AS told FROM e, c WHERE at_us <= c""")
def stream_daily_quota(spark, d):
    own = F.when(F.col("user_id") % 3 == 0, F.lit(str(FEW_CALLS)))
    return _told(spark, d, own, DailyQuota(CALLS)).select("user_id", F.col("event").alias("event_id"), "told")


@query(f"""WITH {_CUT}, e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
r AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS i FROM e WHERE event_type = 'error')
SELECT user_id, event_id, at_us FROM r, c WHERE i % 3 = 0 AND at_us <= c""")
def stream_selector_decay(spark, d):
    failed = F.when(F.col("event_type") == "error", "fail").otherwise("ok")
    return _told(spark, d, failed, FailureCounter()).select("user_id", F.col("event").alias("event_id"), "at_us")


@query(f"""WITH {_CUT}, e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS next_us FROM events),
x AS (
  SELECT user_id, event_id, at_us, event_type AS told FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, NULL, at_us + {SILENT * 3_600_000_000}, 'failed' FROM e WHERE event_type <> 'purchase' AND (next_us IS NULL OR next_us > at_us + {SILENT * 3_600_000_000})
), f AS (SELECT x.*, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS i FROM x)
SELECT user_id, event_id, at_us, told FROM f, c WHERE i = 1 AND CASE WHEN told = 'failed' THEN at_us < c ELSE at_us <= c END""")
def stream_reaped_jobs(spark, d):
    out = _told(spark, d, F.col("event_type"), Reaper(("purchase",), SILENT * 3600))
    return out.select("user_id", F.col("event").alias("event_id"), "at_us", "told")


@query("""WITH r AS (SELECT user_id AS job, event_id % 7 AS chunk, count(*) AS n, arg_max(event_type, (ts, event_id)) AS result FROM events GROUP BY ALL)
SELECT job, count(*) AS chunks, count(*) FILTER (result <> 'error') AS done, least(98, greatest(1, CAST(floor(count(*) FILTER (result <> 'error') / 7.0 * 98) AS BIGINT)))::BIGINT AS progress FROM r GROUP BY job""")
def stream_chunk_results(spark, d):
    """Results of chunks as they come; a retry writes over its chunk's last result, whatever batch it comes in."""
    events = table(spark, d, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 7).alias("chunk"), F.struct("ts", "event_id", F.col("event_type").alias("result")).alias("last"), "ts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.drop("ts").schema)
    merged = MergedTable(spark, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex[:12]}", schema, ["job", "chunk"], {"last": newest})

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("job", "chunk").agg(F.max("last").alias("last"))
        merged.put(last, number)
        # A batch that comes again, as after a failure behind the commit, changes nothing.
        merged.put(last, number)

    replay(events, "ts", PARTS, put)
    done = F.count_if(F.col("last.result") != "error")
    out = merged.read().groupBy("job").agg(F.count("*").alias("chunks"), done.alias("done"))
    return out.withColumn("progress", F.least(F.lit(98), F.greatest(F.lit(1), F.floor(F.col("done") / 7.0 * 98))).cast("bigint"))


#: Remote statuses by the kind of event.
_REMOTE = {"view": "running", "click": "pending", "signup": "unavailable", "error": "not_found", "purchase": "completed"}


@query(f"""WITH RECURSIVE {_CUT}, e AS (SELECT user_id, event_id, epoch_us(ts) AS at_us, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REMOTE.items())} END AS said, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS at_us, 'pending' AS was, 'pending' AS now FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.at_us, s.now, CASE WHEN s.now IN ('completed', 'failed', 'cancelled') OR said = 'unavailable' THEN s.now WHEN said = 'not_found' THEN 'failed' ELSE said END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1
) SELECT user_id, event_id, at_us, now AS status FROM s, c WHERE now <> was AND at_us <= c""")
def stream_status_changes(spark, d):
    said = F.create_map(*[F.lit(x) for pair in _REMOTE.items() for x in pair])[F.col("event_type")]
    return _told(spark, d, said, StatusMachine()).select("user_id", F.col("event").alias("event_id"), "at_us", F.col("told").alias("status"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' OR event_type = 'view' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_id % 2 = 0),
s AS (
  SELECT user_id, event_id, bad, i, 1 AS round, CASE WHEN bad THEN 1 ELSE 0 END AS hung FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.bad, e.i, CASE WHEN s.hung = 3 THEN s.round + 1 ELSE s.round END, CASE WHEN NOT e.bad THEN 0 WHEN s.hung = 3 THEN 1 ELSE s.hung + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1
) SELECT event_id, user_id, CASE WHEN round <= {N.MAX_ROUNDS} THEN round END AS round, CASE WHEN round <= {N.MAX_ROUNDS} THEN NOT bad END AS ok FROM s""")
def auto_continue(spark, d):
    """Every other event is an item of its user's job, and errors and views are failures; three of them in a row end a round of the job."""
    items = table(spark, d, "events").where("event_id % 2 = 0").select("event_id", "user_id", F.col("event_type").isin("error", "view").alias("bad"))

    def attempt(left: DataFrame) -> DataFrame:
        tried = R.attempts(left.drop("attempted", "ok"), "user_id", ["event_id"], F.col("bad"), F.lit(0))
        return tried.withColumn("ok", ~F.col("bad"))

    out = N.continued(items, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex[:12]}", attempt, "event_id")
    return out.select("event_id", "user_id", "round", "ok")
