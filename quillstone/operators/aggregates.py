"""Aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """F1."""
    return (rows if where is None else rows.filter(where)).groupBy(*keys).agg(F.count("*").alias("n"))


def next_position(links: DataFrame, papers: DataFrame) -> DataFrame:
    """where the next author of each paper goes; 0 for papers without one."""
    last = links.groupBy("paper_id").agg((F.max("position") + 1).alias("next"))
    return papers.select("paper_id").join(last, "paper_id", "left").select("paper_id", F.coalesce("next", F.lit(0)).alias("next"))


def best_generation(rows: DataFrame, identity: list[str]) -> DataFrame:
    """one generation per identity: active first, then the latest."""
    order = [F.desc(F.col("status") == "active"), F.desc_nulls_last("activated_at"), F.desc("updated_at"), F.desc("created_at"), F.desc("id")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(*order))).filter("_n = 1").drop("_n")


def best_score(hits: DataFrame) -> DataFrame:
    """a paper's best hit, ranked within its topic."""
    best = hits.groupBy("topic_id", "paper_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "paper_id")))


def analysis_text(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """a paper's PDF chunks joined by blank lines in order, else its abstract."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_type", "chunk_index", "text"))), lambda x: x["text"])
    text = chunks.filter("chunk_type = 'pdf'").groupBy("paper_id").agg(F.array_join(ordered, "\n\n").alias("body"))
    return papers.join(text, "paper_id", "left").select("paper_id", F.coalesce("body", "abstract").alias("text"))


def batches(rows: DataFrame, group: str, size: int, *order: str) -> DataFrame:
    """consecutive batches of a fixed size within a group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def failure_list(failed: Column) -> Column:
    """The failed items of a group (``item`` is their kind) as ``item id: cause``, in order of id, joined by semicolons."""
    rows = F.array_sort(F.collect_list(F.when(failed, F.struct("id", "item", "cause"))))
    return F.array_join(F.transform(rows, lambda x: F.concat(x["item"], F.lit(" "), x["id"].cast("string"), F.lit(": "), F.coalesce(x["cause"], F.lit("")))), "; ")


def batch_progress(items: DataFrame, low: float = 0.35, span: float = 0.30) -> DataFrame:
    """per batch: items, finished, failed, progress mark, whether it is done, and its failures as ``kind id: cause`` in order of
    id where items have these columns."""
    done = F.count_if(F.col("kind").isin("completed", "failed"))
    out = items.groupBy("batch").agg(F.count("*").alias("total"), done.alias("finished"), F.count_if(F.col("kind") == "failed").alias("failed"), *([failure_list(F.col("kind") == "failed").alias("failures")] if {"id", "item", "cause"} <= set(items.columns) else []))
    return out.withColumn("progress", F.round(F.lit(low) + F.lit(span) * F.col("finished") / F.col("total"), 6)).withColumn("done", F.col("finished") == F.col("total"))


def job_metrics(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """F8: over a job log: processed, failed attempts, retries, terminal failures (failure number ``max_retries`` of a job), queued
    and active jobs."""
    per = events.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("enqueued", "delivered", "completed", "failed")])
    retries = F.least(F.col("failed"), F.lit(max_retries - 1))
    return per.agg(
        F.sum("completed").alias("processed"),
        F.sum("failed").alias("failed_attempts"),
        F.sum(retries).alias("retries"),
        F.count_if(F.col("failed") >= max_retries).alias("terminal"),
        F.sum(F.greatest(F.col("enqueued") - F.col("delivered"), F.lit(0))).alias("queued"),
        F.sum(F.greatest(F.col("delivered") - F.col("completed") - F.col("failed"), F.lit(0))).alias("active"),
    )


def request_metrics(log: DataFrame) -> DataFrame:
    """per service and operation over a request log (status, attempt, ms, rejected)."""
    return log.groupBy("service", "operation").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == 429).alias("throttled"),
        F.count_if(F.col("attempt") > 0).alias("retried"),
        F.count_if("rejected").alias("rejected"),
        F.round(F.avg("ms"), 6).alias("mean_ms"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
    )


def duration_sketches(log: DataFrame, window: str = "1 hour", size: int = 400) -> DataFrame:
    """a mergeable quantile sketch of the durations (``ms``) of every service, operation and window of ``ts``, to be kept and
    combined later."""
    return log.groupBy("service", "operation", F.window("ts", window)["start"].alias("start")).agg(F.kll_sketch_agg_double(F.col("ms").cast("double"), F.lit(size)).alias("sketch"))


def duration_quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """p50, p95 and p99 of the kept sketches' durations by ``keys``. The share of durations up to a value is off by less than a
    hundredth of all at the default size."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*keys, F.kll_sketch_get_n_double("s").alias("requests"), *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)])


def token_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """F10."""
    return calls.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def quota_usage(calls: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """calls of each minute and its day against both limits."""
    minute = calls.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("calls"))
    day = minute.groupBy(F.date_trunc("day", "minute").alias("day")).agg(F.sum("calls").alias("day_calls"))
    joined = minute.withColumn("day", F.date_trunc("day", "minute")).join(day, "day")
    return joined.select("minute", "calls", "day_calls", (F.col("calls") > per_minute).alias("over_minute"), (F.col("day_calls") > per_day).alias("over_day"))


def readiness(checks: DataFrame) -> DataFrame:
    """per probe: ready only if every dependency is, and the state of each."""
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("dependency", "state"))))
    return checks.groupBy("probe").agg(F.bool_and(F.col("state") == "ok").alias("ready"), states.alias("states"))
