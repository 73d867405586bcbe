"""Task states with timers: rules, late and repeated events, restarts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.plans import catalogue
from weftline.streaming import machine as M
from weftline.streaming import tasks

catalogue.load()

MIN, DAY = 60_000, 1440
SCHEMA = "task string, at timestamp, id long, stage string, status string"


def _fold(*events, upto, **rules):
    return M.Rules(**rules).fold(M.Task(), [(at * MIN, str(i), stage, status, None, status == "completed", False) for i, (at, stage, status) in enumerate(events)], upto * MIN)


def test_rules():
    t = _fold((0, "scan", "running"), (5, "scan", "completed"), (10, "write", "running"), upto=15)
    assert (t.status, t.last_success, t.resumes) == ("running", "scan", 0)
    t = _fold((0, "scan", "completed"), upto=6)
    assert (t.status, t.reason, t.last_success, t.updated) == ("pending", "zombie", "scan", 5 * MIN)
    t = _fold(*[(10 * i, "scan", "running") for i in range(4)], upto=100)
    assert (t.status, t.reason, t.resumes) == ("failed", "zombie", 3)
    t = _fold(*[(4 * i, "scan", "running") for i in range(40)], upto=100)
    assert (t.status, t.reason, t.updated, t.n_refused) == ("failed", "deadline", 100 * MIN, 40 - 26)
    t = _fold((0, "scan", "running"), (1, "completed", "completed"), (2, "scan", "running"), upto=50)
    assert (t.status, t.n_refused, t.n_events) == ("completed", 1, 3)
    t = _fold((0, "write", "running"), (1, "scan", "running"), (2, "scan", "failed"), upto=50, allowed={None: frozenset({"scan"}), "scan": frozenset({"write"})})
    assert (t.status, t.n_refused, t.current_stage) == ("failed", 1, "scan")


def _run(spark, folder, base, rules):
    M.prepared(spark)
    e = tasks.read(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_a_batch=1)
    out = M.states(e, "task", "at", "id", F.col("stage"), F.col("status"), F.lit(None), F.col("status") == "completed", F.col("stage") == "scan", rules, "30 minutes")
    q = tasks.run_once(out, f"{base}/state", lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/{i}"), "update")
    if q.exception():
        raise q.exception()
    return M.latest(spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out"))


def test_stream_is_the_fold_whatever_the_arrival(spark, tmp_path):
    r = random.Random(11)
    events = []
    for task in range(12):
        at = DAY  # a watermark begins at the epoch
        for i in range(25):
            at += r.choice([0, 1, 2, 4, 7]) if r.random() > 0.06 else 40
            stage, status = r.choice([("scan", "running"), ("scan", "completed"), ("write", "running"), ("write", "completed")])
            events.append((f"t{task}", at, task * 100 + i, stage, status))
    events.append(("end", DAY + 1000, 0, "scan", "running"))
    # Late by up to 25 minutes, three times over; then a second start of the query with the rest.
    arrival = sorted(events, key=lambda e: (e[1] + r.randint(0, 25), e[2]))
    cuts = [arrival[:100], arrival[90:200] + arrival[150:170], arrival[200:]]
    folder, base, rules = str(tmp_path / "in"), str(tmp_path), M.Rules(zombie=9 * MIN, deadline=70 * MIN)
    for part in (cuts[:2], cuts[2:]):
        for rows in part:
            df = spark.createDataFrame([(a, c, d, e, f) for a, c, d, e, f in rows], "task string, m long, id long, stage string, status string")
            df.select("task", F.timestamp_seconds(F.col("m") * 60).alias("at"), "id", "stage", "status").coalesce(1).write.mode("append").parquet(folder)
        got = {x["key"]: x for x in _run(spark, folder, base, rules).collect()}
    for task in {e[0] for e in events} - {"end"}:
        mine = [(at * MIN, str(i), stage, status, None, status == "completed", stage == "scan") for k, at, i, stage, status in events if k == task]
        want = rules.fold(M.Task(), mine, (DAY + 970) * MIN)
        assert {n: got[task][n] for n in vars(want) if n != "version"} == {n: v for n, v in vars(want).items() if n != "version"}


@pytest.mark.parametrize("rows", [[], [(None, None, 1, "a", "running")]])
def test_nothing_to_say(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    M.prepared(spark)
    e = tasks.read(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    q = tasks.run_once(M.states(e, "task", "at", "id", F.col("stage"), F.col("status"), F.lit(1), F.lit(None).cast("boolean"), F.lit(True)), f"{tmp_path}/state", lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"), "update")
    assert q.exception() is None


def test_query_agrees_on_tasks_that_have_not_ended(spark, tmp_path):
    """One task still runs when the watermark stands, one has failed, one waits to start again."""
    rows = [(1, 10 * DAY - 5, "signup"), (1, 10 * DAY, "purchase"), (2, 10 * DAY, "signup"), (2, 30 * DAY, "view"), (3, 9 * DAY, "signup"), (4, 10 * DAY + DAY, "view")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "event_id long, user_id long, m long, event_type string")
    for name, part in (("running", df.where("user_id <> 2")), ("ended", df)):
        events = part.select("event_id", F.expr("cast(timestamp_seconds(m * 60) as timestamp_ntz)").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        events.coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        con = duckdb.connect()
        con.execute(f"create view events as select * from read_parquet('{tmp_path}/{name}/events.parquet/*.parquet')")
        want = con.execute(catalogue.ORACLE_SQL["task_machine"]).fetchall()
        got = catalogue.QUERIES["task_machine"](spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r["attempts"] is None for r in got)
