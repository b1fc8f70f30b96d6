"""Job and stage state over event logs (J1-J8), as batch plans and as Structured Streaming queries.

The events carry what the state needs, so batch plans are grouped maxima and counts. A streaming query keeps the state of
each key in the state store (``processors``) and writes the rows that a micro-batch changed under the batch's number, so a
repeated batch changes nothing; replayed events are dropped first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

TERMINAL = ["completed", "failed"]


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once; on a stream its watermark bounds what is remembered."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def job_state(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per job its attempts, retries and state. The failure number ``max_retries`` is the last, after it the job is dead;
    a completion removes it. Associative counts and the last event, so partial results combine."""
    last = F.max_by("kind", F.struct("ts", "event_id"))
    per = events.groupBy("job_id").agg(F.count_if(F.col("kind") == "failed").alias("failures"), F.count_if(F.col("kind") == "delivered").alias("attempts"), F.count_if(F.col("kind") == "completed").alias("completions"), last.alias("last"), F.max("ts").alias("last_seen"))
    state = F.when(F.col("failures") >= max_retries, "dead").when(F.col("last") == "completed", "done").when(F.col("last") == "delivered", "processing").otherwise("queued")
    return per.withColumn("retries", F.least("failures", F.lit(max_retries))).withColumn("state", state)


def dead_letters(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """The failure that killed each dead job, with its error and time."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.filter("kind = 'failed'").withColumn("n", n).filter(F.col("n") == max_retries).select("job_id", "event_id", "ts", "error")


def stuck_jobs(events: DataFrame, now: object, idle_ms: int) -> DataFrame:
    """Jobs delivered, not finished, and silent for longer than ``idle_ms``; all of them."""
    s = job_state(events).filter("last = 'delivered'")
    return s.filter(F.unix_millis(now) - F.unix_millis(F.col("last_seen").cast("timestamp")) > idle_ms).select("job_id", "last_seen")


def stage_state(events: DataFrame) -> DataFrame:
    """``(run_id, stage, kind started|completed|failed, ts, event_id)`` -> current row with attempts. A failure is
    recorded as a start that failed, so it counts as an attempt too."""
    return events.groupBy("run_id", "stage").agg(F.count_if(F.col("kind").isin("started", "failed")).alias("attempt"), F.max_by("kind", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("kind") == "failed").alias("failures"))


def queue_depth(events: DataFrame) -> DataFrame:
    """J4."""
    per = events.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("enqueued", "delivered", "completed", "failed")])
    waiting = F.greatest(F.col("enqueued") - F.col("delivered"), F.lit(0))
    active = F.greatest(F.col("delivered") - F.col("completed") - F.col("failed"), F.lit(0))
    return per.agg(F.sum(waiting).alias("ready"), F.sum(active).alias("processing"), F.count_if(F.col("failed") >= 3).alias("dead"))


def latest_status(events: DataFrame, key: str, now: object, ttl_hours: int = 24) -> DataFrame:
    """The last event of each key that is not older than the time to live."""
    last = events.groupBy(key).agg(F.max_by(F.struct("kind", "event_id", "ts"), F.struct("ts", "event_id")).alias("r")).select(key, "r.*")
    return last.filter(F.col("ts").cast("timestamp") >= now - F.expr(f"INTERVAL {ttl_hours} HOURS"))


def status_stream(snapshot: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The current state of each key first (sequence 0), then its events in order."""
    first = snapshot.select(key, "kind", F.lit(0).alias("sequence"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return first.unionByName(events.select(key, "kind", n.alias("sequence")))


#: The stages of a run and the progress mark that each begins with.
STAGES = [("query_expansion", 0.05), ("discovery", 0.15), ("ranking", 0.25), ("analysis", 0.35), ("gap_detection", 0.65), ("feasibility", 0.80), ("report", 0.90)]


def run_progress(checkpoints: DataFrame) -> DataFrame:
    """Per run the next stage, progress and status from its ``(run_id, stage, status)`` checkpoints: completed stages
    are not repeated, the first failed one stops the run."""
    stages = F.array(*[F.lit(s) for s, _ in STAGES])
    marks = F.array(*[F.lit(m) for _, m in STAGES])
    per = checkpoints.groupBy("run_id").agg(F.collect_set(F.when(F.col("status") == "completed", F.col("stage"))).alias("done"), F.min(F.when(F.col("status") == "failed", F.col("stage"))).alias("failed"))
    todo = F.filter(F.sequence(F.lit(0), F.lit(len(STAGES) - 1)), lambda i: ~F.array_contains(F.col("done"), F.get(stages, i)))
    per = per.withColumn("next", F.get(todo, 0))
    status = F.when(F.col("next").isNull(), "completed").when(F.col("failed").isNotNull(), "failed").otherwise("processing")
    return per.select("run_id", F.get(stages, F.col("next")).alias("stage"), F.coalesce(F.get(marks, F.col("next")), F.lit(1.0)).alias("progress"), status.alias("status"))


def run_pipeline(stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], tables: dict[str, DataFrame], store: object, run_id: str) -> list[str]:
    """Run stages in order over all open topics. Each result is committed to the table store and then recorded; a stage
    whose table the run has already committed is read back, so a restart goes on where it stopped."""
    ran = []
    for name, stage in stages:
        key = f"{run_id}-{name}"
        try:
            tables[name] = store.read(key)
        except ValueError:
            store.commit(key, stage(tables))
            tables[name] = store.read(key)
            ran.append(name)
    return ran


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far events may be out of order between files.
DELAY = "10 minutes"


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch's rows go to ``out``/batch=<number>, a folder for each ``what``: all its tables in one write, and the same
    batch again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("what").parquet(f"{out}/batch={number}")

    return write


def follow(spark: SparkSession, path: str, schema: str, key: str, processor: StatefulProcessor, rows: str, out: str, checkpoint: str, files: int = 1000, delay: str = DELAY) -> StreamingQuery:
    """Follow a folder of JSON events (with ``event_id`` and ``ts``) through a processor whose state is kept by ``key``: each
    batch reads its own events and the state of their keys. The state store must be RocksDB, which is set for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.createDataFrame([], rows).write.mode("overwrite").partitionBy("what").parquet(f"{out}/batch=-1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    events = distinct_events(stream.withWatermark("ts", delay)).withColumn("us", F.unix_micros("ts")).drop("ts")
    found = events.groupBy(key).transformWithState(processor, rows, "Append", "EventTime")
    return found.writeStream.foreachBatch(batch_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_rows(spark: SparkSession, out: str, rows: str, what: str) -> DataFrame:
    """All rows of a kind, with the number of their batch."""
    return spark.read.schema(f"{rows}, batch long").parquet(out).filter(F.col("what") == what).drop("what")


def current_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of each key after the last batch that changed it."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").drop("batch")


def current_statuses(spark: SparkSession, out: str, rows: str) -> DataFrame:
    """The last event of every key that is still in the store; of a batch that lets a key expire and sets it, the later
    event counts."""
    every = spark.read.schema(f"{rows}, batch long").parquet(out)
    last = every.groupBy("key").agg(F.max_by(F.struct("what", "kind", "event_id", "us"), F.struct("us", "event_id", F.col("what") == "expired")).alias("r"))
    return last.select("key", "r.*").filter("what = 'set'").drop("what")


def depth_after(spark: SparkSession, out: str, rows: str) -> DataFrame:
    """Ready, processing and dead jobs, from what each batch added; dead letters before the last clearing are gone."""
    states = written_rows(spark, out, rows, "state").agg(F.coalesce(F.sum("ready"), F.lit(0)).alias("ready"), F.coalesce(F.sum("processing"), F.lit(0)).alias("processing"))
    kinds = written_rows(spark, out, rows, "clear").select("us", F.lit(1).alias("clear")).unionByName(written_rows(spark, out, rows, "dead").select("us", F.lit(0).alias("clear")))
    cleared = F.coalesce(F.max(F.when(F.col("clear") == 1, F.col("us"))), F.lit(-(1 << 62)))
    last = kinds.agg(cleared.alias("cleared"))
    dead = kinds.filter("clear = 0").join(last.hint("broadcast"), F.col("us") > F.col("cleared")).agg(F.count("*").alias("dead"))
    return states.join(dead.hint("broadcast"))
