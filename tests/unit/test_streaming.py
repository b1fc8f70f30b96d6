"""Job, status and run streams: what leaves the state store, what a batch reads, and what a repeated batch changes."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from quillstone.plans.events import _followed
from quillstone.streaming import processors as P
from quillstone.streaming import state as J

DAY = datetime(2024, 3, 1, tzinfo=UTC)
JOBS = "event_id long, ts timestamp, job_id long, kind string, error string"


def at(minutes):
    return (DAY + timedelta(minutes=minutes)).isoformat()


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a processor over one file per batch and again when called again with further files."""
    src = tmp_path / "src"
    src.mkdir()

    def run(files, schema, key, processor, rows):
        names = schema.split(", ")
        for k, events in enumerate(files, start=len(list(src.iterdir()))):
            lines = [json.dumps(dict(zip([n.split()[0] for n in names], e, strict=True))) for e in events]
            (src / f"{k:03}.json").write_text("\n".join(lines))
            query = J.follow(spark, str(src), schema, key, processor, rows, str(tmp_path / "out"), str(tmp_path / "offsets"), files=1)
            query.awaitTermination()
        return str(tmp_path / "out"), query

    return run


def events(rows):
    return [(i, at(m), j, k, f"e{i}") for i, m, j, k in rows]


def test_jobs(spark, stream):
    first = [(1, 0, 1, "enqueued"), (2, 1, 1, "delivered"), (3, 2, 1, "failed"), (4, 3, 2, "enqueued"), (5, 4, 2, "delivered"), (6, 4, 3, "delivered")]
    second = [(7, 20, 1, "failed"), (3, 2, 1, "failed"), (8, 21, 2, "completed"), (9, 22, 4, "cleared")]
    third = [(10, 30, 1, "failed"), (11, 31, 5, "delivered"), (12, 60 * 30, 6, "enqueued")]
    out, query = stream([events(x) for x in (first, second, third)], JOBS, "job_id", P.JobProcessor(keep_ms=60 * 60 * 1000), P.JOB_ROWS)
    state = {r["job_id"]: (r["state"], r["attempts"], r["failures"]) for r in J.current_rows(J.written_rows(spark, out, P.JOB_ROWS, "state"), "job_id").collect()}
    assert state == {1: ("dead", 1, 3), 2: ("done", 1, 0), 3: ("processing", 1, 0), 5: ("processing", 1, 0), 6: ("queued", 0, 0)}
    dead = J.written_rows(spark, out, P.JOB_ROWS, "dead").select("job_id", "event_id", "error", F.timestamp_micros("us").alias("ts")).collect()
    assert [(r["job_id"], r["event_id"], r["error"]) for r in dead] == [(1, 10, "e10")]
    # job 2 was silent for 17 minutes before it was completed, 3 and 5 fall silent; each is told once
    assert sorted((r["job_id"], r["event_id"]) for r in J.written_rows(spark, out, P.JOB_ROWS, "stuck").collect()) == [(2, 5), (3, 6), (5, 11)]
    assert tuple(J.depth_after(spark, out, P.JOB_ROWS).first()) == (1, 2, 1)
    last = [p for p in query.recentProgress if p["stateOperators"]]
    assert max(p["numInputRows"] for p in last) == 3  # a batch reads its own events
    kept = next(o for o in last[-1]["stateOperators"] if "transformWithState" in o["operatorName"])
    assert kept["numRowsRemoved"] >= 2 or kept["numRowsTotal"] <= 8  # jobs 1 and 2 have left


def test_a_cleared_queue_has_no_dead_jobs(spark, stream):
    rows = [(k, k, 1, "failed") for k in range(1, 4)] + [(4, 4, 9, "cleared"), *((k, k, 2, "failed") for k in range(5, 8))]
    out, _ = stream([events(rows)], JOBS, "job_id", P.JobProcessor(), P.JOB_ROWS)
    assert tuple(J.depth_after(spark, out, P.JOB_ROWS).first()) == (0, 0, 1)


def test_old_statuses_leave_the_store(spark, stream):
    schema = "event_id long, ts timestamp, key long, kind string"
    first = [(1, at(0), 1, "a"), (2, at(1), 1, "b"), (3, at(2), 2, "c")]
    second = [(4, at(60), 2, "d"), (5, at(3), 1, "late, but newer")]
    third = [(6, at(240), 3, "e")]
    out, query = stream([first, second, third], schema, "key", P.StatusProcessor(ttl_ms=120 * 60 * 1000), P.STATUS_ROWS)
    assert {(r["key"], r["kind"]) for r in J.current_statuses(spark, out, P.STATUS_ROWS).collect()} == {(3, "e")}
    expired = {(r["key"], r["event_id"]) for r in J.written_rows(spark, out, P.STATUS_ROWS, "expired").collect()}
    assert {k for k, _ in expired} == {1, 2} and (2, 4) in expired
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert kept and kept[-1] <= 3 < max(8, *kept)  # one key with its timer


def test_runs_and_topics_change_together(spark, stream):
    schema = "event_id long, ts timestamp, run_id long, stage string, kind string, error string"
    names = [n for n, _ in J.STAGES]
    first = [(1, at(0), 1, names[0], "started", None), (2, at(1), 1, names[0], "completed", None), (3, at(2), 1, names[1], "started", None), (4, at(3), 1, names[1], "failed", "no papers")]
    second = [(5, at(20), 1, names[1], "started", None), (6, at(21), 1, names[1], "completed", None), (7, at(22), 1, names[-1], "completed", None)]
    out, _ = stream([first, second], schema, "run_id", P.RunProcessor(dict(J.STAGES)), P.RUN_ROWS)

    def tables():
        stage = J.current_rows(J.written_rows(spark, out, P.RUN_ROWS, "stage"), "run_id", "stage").collect()
        topic = J.current_rows(J.written_rows(spark, out, P.RUN_ROWS, "topic"), "run_id").collect()
        return {r["stage"]: (r["status"], r["attempt"], r["failures"], r["error"]) for r in stage}, [(r["status"], r["stage"], r["progress"], r["error"]) for r in topic]

    want = {names[0]: ("completed", 1, 0, None), names[1]: ("completed", 3, 1, None), names[-1]: ("completed", 0, 0, None)}
    assert tables() == (want, [("completed", names[-1], 1.0, None)])
    every = J.written_rows(spark, out, P.RUN_ROWS, "topic").orderBy("batch").collect()
    assert [(r["status"], r["error"]) for r in every] == [("failed", "no papers"), ("completed", None)]
    # a batch that is repeated after a lost driver writes the same rows over its own
    batches = {r["batch"] for r in every}
    own = spark.read.schema(P.RUN_ROWS).parquet(f"{out}/batch={max(batches)}")
    again = spark.createDataFrame(own.collect(), own.schema)
    J.batch_writer(out)(again, max(batches))
    assert tables() == (want, [("completed", names[-1], 1.0, None)])


class Store:
    """A key's state and timers, with the number of calls to them."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


@pytest.mark.parametrize("make", [lambda: P.JobProcessor(), lambda: P.StatusProcessor(), lambda: P.RunProcessor(dict(J.STAGES))])
def test_a_batch_calls_the_store_twice_a_key(make):
    fields = Row("event_id", "us", "kind", "error", "stage")
    processor, store = make(), Store()
    processor.init(store)
    for batch in range(4):
        rows = [fields(10 * batch + k, 1_000_000 * (10 * batch + k), "failed", f"e{k}", J.STAGES[k % 7][0]) for k in range(10)]
        store.calls = 0
        list(processor.handleInputRows((1,), iter(rows), None))
        assert store.calls <= (2 if batch else 3)  # the state is read and written once; the first batch sets a timer
    assert len(store.timers) <= 1


def test_a_quarter_of_several_files_is_one_batch(spark):
    """Times lie in the first and last quarter only; every batch has its files though the others have no events."""
    e = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") < 200, F.col("id")).otherwise(F.col("id") * 10_000)).alias("ts"), (F.col("id") % 7).alias("key"), F.lit("k").alias("kind"))
    out = _followed(spark, e, "key", P.StatusProcessor(ttl_ms=10**12), P.STATUS_ROWS, file_events=20)
    got = {r["key"]: r["event_id"] for r in J.current_statuses(spark, out, P.STATUS_ROWS).collect()}
    assert got == {k: max(i for i in range(400) if i % 7 == k) for k in range(7)}
    n = {r["batch"] for r in J.written_rows(spark, out, P.STATUS_ROWS, "set").collect()}
    assert len(n) == 4 - 1  # the second quarter adds nothing
