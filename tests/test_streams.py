import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import continued as N
from millrace.streaming.replay import appended
from millrace.streaming.sink import MergedTable, maps, newest, patched
from millrace.streaming.state import DailyQuota, FailureCounter, Reaper, StatusMachine, advance, follow

DAY, HOUR = 86_400_000_000, 3_600_000_000
FOLDS = {"reaper": Reaper(("done",), 3600), "forgetful": Reaper(("done",), 3600, 7200), "failures": FailureCounter(3), "quota": DailyQuota(4), "status": StatusMachine(), "forgotten": StatusMachine(3600)}


@pytest.mark.parametrize("name", FOLDS)
def test_batches_and_order_of_arrival_change_nothing(name):
    """Events in any order within the delay, cut into any batches, tell what all of them at once tell."""
    rng, delay = random.Random(5), 600_000_000
    for _ in range(40):
        values = {"quota": [None, "2", "0", "-3"], "failures": ["fail", "fail", "ok", None], "status": ["running", "pending", "unavailable", None], "forgotten": ["running", "completed", "not_found"]}.get(name, ["run", "run", "done", None])
        events = [(rng.randrange(3 * DAY if name == "quota" else 8 * HOUR), i, rng.choice(values)) for i in range(40)]
        whole, rest = advance(FOLDS[name], events, {}, 10 * DAY)
        assert not rest
        arriving, waiting, state, out, top = sorted(events, key=lambda e: e[0] + rng.randrange(delay)), [], {}, [], 0
        while arriving:
            n = rng.randrange(1, 9)
            waiting, arriving = waiting + arriving[:n], arriving[n:]
            told, waiting = advance(FOLDS[name], waiting, state, max(top - delay, 0))
            out, top = out + told, max([top, *(e[0] for e in waiting)])
        assert out + advance(FOLDS[name], waiting, state, 10 * DAY)[0] == whole


def test_folds_tell_what_they_should():
    m = 60_000_000
    tell = lambda fold, rows, until=DAY: [(at // m, event, told) for at, event, told in advance(fold, [(at * m, i, v) for i, (at, v) in enumerate(rows)], {}, until)[0]]
    assert tell(Reaper(("done",), 3600), [(0, "run"), (59, "run"), (119, "run"), (180, "done")]) == [(179, None, "failed")]
    assert tell(Reaper(("done",), 3600), [(0, "run"), (60, "done"), (61, "run")]) == [(60, 1, "done")]
    assert tell(Reaper(("done",), 3600, 600), [(0, "done"), (5, "done"), (11, "done")]) == [(0, 0, "done"), (11, 2, "done")]
    assert tell(FailureCounter(2), [(i, "fail") for i in range(5)]) == [(1, 1, "deleted"), (3, 3, "deleted")]
    assert tell(DailyQuota(1), [(0, None), (1439, None), (1440, None), (1441, "2")], 2 * DAY) == [(0, 0, "allowed"), (1439, 1, "refused"), (1440, 2, "allowed"), (1441, 3, "allowed")]
    state = {}
    advance(DailyQuota(1), [(0, 0, None)], state, 2 * DAY)
    assert state == {}


def test_late_events_null_keys_and_restarts(spark, tmp_path):
    """Three runs with one checkpoint; what is late within the delay counts, what is later does not, and nulls are left out."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "own string, t timestamp, n bigint, v string"
    parts = [[("a", at(0), 1, "run"), ("b", at(30), 2, "run"), (None, at(31), 3, "done"), ("a", None, 4, "done")], [("a", at(25), 5, "done"), ("b", at(2), 6, "done"), ("c", at(200), 7, "run")], [("d", at(500), 8, "run"), ("c", at(195), 9, "done"), ("c", at(150), 10, "done")]]

    def run(put):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "own", "t", "n", F.col("v"), Reaper(("done",), 3600))
            stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    told = appended(spark, run, "own string, at timestamp, event long, told string")
    assert sorted((r.own, r["at"], r.event, r.told) for r in told.collect()) == [("a", at(25), 5, "done"), ("b", at(90), None, "failed"), ("c", at(195), 9, "done")]


def test_merged_table_takes_each_batch_once(spark, tmp_path):
    schema = "k string, i int, v struct<t:int,x:string>, note string, more map<string,int>"
    table = lambda: MergedTable(spark, f"file://{tmp_path}/t", schema, ["k", "i"], {"v": newest, "note": patched, "more": maps}, 4)
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    rows = lambda: sorted([(r.k, r.i, tuple(r.v), r.note, r.more) for r in table().read().collect()], key=repr)
    assert rows() == []
    table().put(batch(("a", 1, (5, "x"), "n", {"p": 1}), (None, 1, (1, "y"), None, None)), 0)
    first = rows()
    assert first == sorted([("a", 1, (5, "x"), "n", {"p": 1}), (None, 1, (1, "y"), None, None)], key=repr)
    table().put(batch(("a", 1, (9, "again"), "again", {"again": 1})), 0)
    assert rows() == first
    # A batch that failed before its commit is not seen, and its next attempt is.
    batch(("a", 1, (9, "torn"), "torn", None)).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{tmp_path}/t/batch-7")
    assert rows() == first
    new = [("a", 1, (4, "late"), None, {"q": 2, "p": None}), (None, 1, (2, "z"), "m", {"r": 3}), ("b", None, (0, ""), None, None)]
    for _ in range(2):
        table().put(batch(*new), 7)
        assert rows() == sorted([("a", 1, (5, "x"), "n", {"p": 1, "q": 2}), (None, 1, (2, "z"), "m", {"r": 3}), ("b", None, (0, ""), None, None)], key=repr)
    table().put(batch().limit(0), 8)
    table().put(batch(("late", 0, (0, ""), "", None)), 3)
    assert len(rows()) == 3 and table().committed()[0] == 8


def test_merged_table_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    t = MergedTable(spark, f"file://{tmp_path}/t", "k int, n int", ["k"], {"n": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}, 16)
    t.put(spark.createDataFrame([(i, i) for i in range(200)], "k int, n int"), 0)
    t.put(spark.createDataFrame([(7, 100)], "k int, n int"), 1)
    assert sorted(t.committed()[1].values()) == [0] * 15 + [1]
    assert {r.k: r.n for r in t.read().collect()} == {i: i + 100 * (i == 7) for i in range(200)}


def test_a_bucket_of_a_merged_table_is_one_file(spark, tmp_path):
    """However many tasks a batch has, a bucket that it touches is written as one file, so later batches read few files."""
    t = MergedTable(spark, f"file://{tmp_path}/t", "n int, o int, v int", ["n"], {"o": patched, "v": newest}, 4)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    for number in range(2):
        t.put(spark.range(0, 4000, 1, 16).select(F.col("id").cast("int").alias("n"), F.lit(None).cast("int").alias("o"), F.lit(number).alias("v")), number)
    spark.conf.unset(coalesced)
    assert all(len(list(tmp_path.glob(f"t/batch-{b}/_bucket={k}/part-*"))) == 1 for b in range(2) for k in range(4))
    assert [tuple(r) for r in t.read().groupBy("o", "v").count().collect()] == [(None, 1, 4000)]


def test_late_results_do_not_overwrite_an_end():
    said = ["unavailable", "running", "running", "unavailable", "odd", None, "pending", "not_found", "completed", "running"]
    told, _ = advance(StatusMachine(), [(i, i, v) for i, v in enumerate(said)], {}, DAY)
    assert told == [(1, 1, "running"), (6, 6, "pending"), (7, 7, "failed")]
    assert advance(StatusMachine(), [(0, 0, "cancelled"), (1, 1, "completed")], {}, DAY)[0] == [(0, 0, "cancelled")]


def test_of_two_runs_one_claims_a_round(spark, tmp_path):
    """Both read version 0; the first to claim it writes version 1, and the other's claim of what it read fails."""
    attempt = lambda left: left.withColumn("attempted", F.col("url") < "c").withColumn("ok", F.lit(True))
    folder = f"file://{tmp_path}/rounds"
    one, two = N.Versions(spark, folder), N.Versions(spark, folder)
    items = spark.createDataFrame([("a", False, None, None), ("c", False, None, None), (None, False, None, None)], "url string, attempted boolean, ok boolean, round int")
    one.write(items, 0)
    assert one.last() == two.last() == 0 and two.claim(0) and not one.claim(0)
    assert N.round_once(one, attempt) == "taken" and one.last() == 0
    two.write(two.read(0), 1)
    assert not one.claim(0) and N.round_once(one, attempt) == "went" and not two.claim(1)
    assert sorted(map(tuple, one.read(2).collect()), key=repr) == sorted([("a", True, True, 2), ("c", False, None, None), (None, False, None, None)], key=repr)
    # A round that attempts nothing more counts too, so the loop ends.
    assert N.round_once(one, attempt, rounds=3) == "went" and N.round_once(one, attempt, rounds=3) == "done"


def test_what_is_left_is_tried_until_the_last_round(spark, tmp_path):
    items = spark.createDataFrame([(i, i % 3) for i in range(30)], "url int, k int")
    attempt = lambda left: left.withColumn("attempted", F.col("url") == left.agg(F.min("url")).first()[0]).withColumn("ok", F.col("k") > 0)
    got = N.continued(items, f"file://{tmp_path}/t", attempt, rounds=4)
    assert sorted((r.url, r.ok, r.round) for r in got.where("attempted").collect()) == [(0, False, 1), (1, True, 2), (2, True, 3), (3, False, 4)] and got.where("round is null").count() == 26
    assert N.continued(items.limit(0), f"file://{tmp_path}/u", attempt).count() == 0


def test_urls_that_need_another_selector(spark):
    items = spark.createDataFrame([("f2", "failed", 2), ("f1", "failed", 1), ("ok", "success", 0), (None, "failed", 0), ("", "failed", 0), ("f1", "failed", 9)], "url string, status string, o int")
    results = spark.createDataFrame([("b", "body_fallback", 1), ("f2", "body_fallback", 0), ("h", "heuristic", 0)], "url string, resolved_by string, o int")
    assert [tuple(r) for r in N.research_urls(items, results, "o").collect()] == [("f1", 0), ("f2", 0), ("b", 1)]
    assert N.research_urls(items, results, "o", 1).count() == 1
