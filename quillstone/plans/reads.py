"""Queries of reads (E) and aggregations (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import reads as R
from .views import JOB_EVENTS, LINKS, PAPERS, TOPIC_PAPERS, job_events, links, papers, table, topic_papers


def _authors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey")


def papers_with_authors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).withColumn("analysis", F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END"))
    out = R.with_authors(rows, links(spark, sf), _authors(spark, sf))
    return out.select("paper_id", F.array_join("authors", "; ").alias("authors"), F.size("authors").alias("n"))


def topic_papers_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return R.papers_of_topics(papers(spark, sf).drop("topic_id"), topic_papers(spark, sf)).select("topic_id", "paper_id", "score", "year")


def paper_author_rows(spark: SparkSession, sf: str) -> DataFrame:
    named = links(spark, sf).join(_authors(spark, sf), "author_id")
    return R.in_key_order(named, "paper_id", "position", "author_id").select("paper_id", "position", "name")


def status_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).withColumnsRenamed({"o_orderstatus": "status", "o_orderdate": "created_at"})
    return R.by_status(rows, "F", "O", exclude=True).select("paper_id", "status", F.col("created_at").cast("date").cast("string").alias("day"))


def topic_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("newest"))
    return R.page(rows, [F.desc("newest"), F.col("source")], 5, 3)


def child_order(spark: SparkSession, sf: str) -> DataFrame:
    return R.children(topic_papers(spark, sf), "topic_id", F.desc_nulls_last("score"), F.col("paper_id")).select("topic_id", "paper_id", "ordinal")


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return R.lookup(papers(spark, sf), source="arxiv", external_id="17").select("paper_id", "title", "year")


def pending_papers(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf)
    return R.pending(t, t.filter("analysis_status = 'completed'"), "topic_id", "paper_id").select("topic_id", "paper_id", "score")


def orphan_papers(spark: SparkSession, sf: str) -> DataFrame:
    owned = table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"))
    return R.orphans(papers(spark, sf), owned).select("paper_id", "source")


def open_intents(spark: SparkSession, sf: str) -> DataFrame:
    rows = job_events(spark, sf).filter("kind IN ('enqueued', 'failed')")
    return R.oldest(rows, 20, "ts", "event_id").select("event_id", "job_id", "kind")


def latest_stage(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(job_events(spark, sf).select("job_id", "kind", "ts", "event_id"), "job_id", "ts", "event_id").select("job_id", "kind", "event_id")


def min_topic(spark: SparkSession, sf: str) -> DataFrame:
    return R.smallest_topic(links(spark, sf).select("paper_id", F.col("author_id").alias("topic_id")))


def twin_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.later_twins(table(spark, sf, "documents").select("doc_id", "source", "text"), ["source", "text"], ["doc_id"]).select("doc_id", "source")


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("topic_id"), "n_chars")
    status = lambda k: F.when((F.col("topic_id") + k) % 5 == 0, "completed").when((F.col("topic_id") + k) % 7 == 0, "failed").otherwise("processing")
    return tuple(d.filter(F.col("topic_id") % m == 0).select("topic_id", status(k).alias("status")) for m, k in ((3, 1), (2, 2), (1, 0)))


_STATE = "CASE WHEN (topic_id + {k}) % 5 = 0 THEN 'completed' WHEN (topic_id + {k}) % 7 = 0 THEN 'failed' ELSE 'processing' END AS status"
_STATES = "d AS (SELECT doc_id AS topic_id FROM documents), " + ", ".join(f"{n} AS (SELECT topic_id, {_STATE.format(k=k)} FROM d WHERE topic_id % {m} = 0)" for n, m, k in (("lo", 3, 1), ("li", 2, 2), ("du", 1, 0)))


def state_priority(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_of(list(_states(spark, sf)), "topic_id", ["status"])


def state_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for every second job and for as many ids that are none or of no topic."""
    asked = job_events(spark, sf).select(F.col("job_id").cast("string").alias("topic_id")).distinct()
    asked = asked.select(F.when(F.col("topic_id").cast("long") % 3 == 0, F.concat(F.lit("no id "), "topic_id")).when(F.col("topic_id").cast("long") % 5 == 0, F.concat(F.lit("99999"), "topic_id")).otherwise(F.col("topic_id")).alias("topic_id"))
    states = [s.withColumn("topic_id", F.col("topic_id").cast("string")) for s in _states(spark, sf)]
    return R.lookup_states(asked, states, ["status"], F.col("topic_id").rlike("^[0-9]+$"))


def recovery_set(spark: SparkSession, sf: str) -> DataFrame:
    _, live, durable = _states(spark, sf)
    marks = job_events(spark, sf).select(F.col("job_id").alias("topic_id"), F.col("kind").alias("stage"), F.col("ts").alias("started_at"))
    return R.recovery(live, durable, marks, ["completed", "failed"])


def term_match(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_match(papers(spark, sf), ["the", "of", "tion"])


def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(topic_papers(spark, sf), "topic_id", "analysis_status")


def next_position(spark: SparkSession, sf: str) -> DataFrame:
    return A.next_position(links(spark, sf), _orders(spark, sf))


def generation_dedup(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("provider"), F.when(F.col("o_orderstatus") == "P", "active").otherwise("ready").alias("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("activated_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    return A.best_generation(rows, ["model", "provider"]).select("model", "provider", "id", "status")


def analysis_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), F.when(F.col("role") == "system", "abstract").otherwise("pdf").alias("chunk_type"), F.col("turn").alias("chunk_index"), "text")
    return A.analysis_text(papers(spark, sf), c).select("paper_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("n"))


def batches_of_n(spark: SparkSession, sf: str) -> DataFrame:
    return A.batches(topic_papers(spark, sf), "topic_id", 10, "paper_id").select("topic_id", "paper_id", "batch")


def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf).withColumns({"batch": F.col("job_id"), "id": F.col("event_id"), "item": F.lit("paper"), "cause": F.col("props")})
    return A.batch_progress(e)


def job_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.job_metrics(job_events(spark, sf))


def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = e.select((F.col("user_id") % 3).alias("service"), F.col("event_type").alias("operation"), F.when(F.col("event_id") % 17 == 0, 429).when(F.col("event_id") % 13 == 0, 503).otherwise(200).alias("status"), (F.col("event_id") % 4).alias("attempt"), F.col("value").alias("ms"), (F.col("event_id") % 19 == 0).alias("rejected"))
    return A.request_metrics(log)


def duration_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of merged hourly sketches, held against the exact shares of durations below them and up to them."""
    log = table(spark, sf, "events").select((F.col("user_id") % 3).alias("service"), F.col("event_type").alias("operation"), "ts", F.col("value").alias("ms"))
    found = A.duration_quantiles(A.duration_sketches(log), "service")
    shares = log.join(found.hint("broadcast"), "service").groupBy("service", "requests")
    near = lambda p, q: (F.avg((F.col("ms") < F.col(p)).cast("int")) <= q + 0.01) & (F.avg((F.col("ms") <= F.col(p)).cast("int")) >= q - 0.01)
    return shares.agg(near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"), near("p99", 0.99).alias("p99_near"))


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.split("text", " ")).cast("long")
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") != "assistant", words).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "assistant", words).otherwise(0).alias("output_tokens"))
    return A.token_usage(c, "conv_id")


def quota_usage(spark: SparkSession, sf: str) -> DataFrame:
    out = A.quota_usage(table(spark, sf, "events").select("ts"), 2, 300)
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("probe"), F.col("event_type").alias("dependency")).agg(F.when(F.max("value") > 190, "down").otherwise("ok").alias("state"))
    return A.readiness(e).select("probe", "ready", F.size(F.map_keys("states")).alias("n"), F.array_join(F.transform(F.map_entries("states"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("states"))


_TERMS = "list_filter(string_split(trim(regexp_replace(lower(abstract), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda t: t <> '')"
QUERIES = {
    "papers_with_authors": (papers_with_authors, f"WITH {LINKS} SELECT o.o_orderkey AS paper_id, coalesce(string_agg(s.s_name, '; ' ORDER BY position, author_id), '') AS authors, count(s.s_name)::INT AS n FROM orders o LEFT JOIN links l ON o.o_orderkey = l.paper_id LEFT JOIN supplier s ON s.s_suppkey = l.author_id WHERE o_orderstatus <> 'O' GROUP BY 1"),
    "topic_papers_ranked": (topic_papers_ranked, f"WITH {PAPERS}, {TOPIC_PAPERS} SELECT t.topic_id, t.paper_id, t.score, p.year FROM topic_papers t JOIN papers p USING (paper_id)"),
    "paper_author_rows": (paper_author_rows, f"WITH {LINKS} SELECT paper_id, position, s_name AS name FROM links JOIN supplier ON s_suppkey = author_id"),
    "status_scan": (status_scan, "SELECT o_orderkey AS paper_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "topic_page": (topic_page, "SELECT source, max(doc_id) AS newest FROM documents GROUP BY source ORDER BY newest DESC, source LIMIT 5 OFFSET 3"),
    "child_order": (child_order, f"WITH {TOPIC_PAPERS} SELECT topic_id, paper_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, paper_id)::INT AS ordinal FROM topic_papers"),
    "point_lookup": (point_lookup, f"WITH {PAPERS} SELECT paper_id, title, year FROM papers WHERE source = 'arxiv' AND external_id = '17'"),
    "pending_papers": (pending_papers, f"WITH {TOPIC_PAPERS} SELECT topic_id, paper_id, score FROM topic_papers WHERE analysis_status = 'pending'"),
    "orphan_papers": (orphan_papers, f"WITH {PAPERS} SELECT paper_id, source FROM papers p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.paper_id)"),
    "open_intents": (open_intents, f"WITH {JOB_EVENTS} SELECT event_id, job_id, kind FROM job_events WHERE kind IN ('enqueued', 'failed') ORDER BY ts, event_id LIMIT 20"),
    "latest_stage": (latest_stage, f"WITH {JOB_EVENTS} SELECT job_id, kind, event_id FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"),
    "min_topic": (min_topic, f"WITH {LINKS} SELECT paper_id, min(author_id::VARCHAR) AS topic_id FROM links GROUP BY 1"),
    "twin_rows": (twin_rows, "SELECT DISTINCT a.doc_id, a.source FROM documents a JOIN documents b ON a.source = b.source AND a.text = b.text AND a.doc_id > b.doc_id"),
    "state_priority": (state_priority, f"WITH {_STATES} SELECT d.topic_id, coalesce(lo.status, li.status, du.status) AS status, CASE WHEN lo.topic_id IS NOT NULL THEN 0 WHEN li.topic_id IS NOT NULL THEN 1 ELSE 2 END AS priority FROM d LEFT JOIN lo USING (topic_id) LEFT JOIN li USING (topic_id) LEFT JOIN du USING (topic_id)"),
    "state_lookup": (state_lookup, f"WITH {_STATES}, a AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'no id ' || user_id WHEN user_id % 5 = 0 THEN '99999' || user_id ELSE user_id::VARCHAR END AS topic_id FROM events) SELECT a.topic_id, coalesce(lo.status, li.status, du.status) AS status, CASE WHEN starts_with(a.topic_id, 'no') THEN 'invalid topic id: \"' || a.topic_id || '\"' WHEN lo.topic_id IS NULL AND li.topic_id IS NULL AND du.topic_id IS NULL THEN 'pipeline not found: ' || a.topic_id END AS error FROM a LEFT JOIN lo ON lo.topic_id::VARCHAR = a.topic_id LEFT JOIN li ON li.topic_id::VARCHAR = a.topic_id LEFT JOIN du ON du.topic_id::VARCHAR = a.topic_id"),
    "recovery_set": (recovery_set, f"WITH {_STATES}, {JOB_EVENTS}, m AS (SELECT job_id AS topic_id, kind AS stage FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, kind DESC) = 1) SELECT du.topic_id, status, coalesce(stage, 'pending') AS stage FROM du LEFT JOIN m USING (topic_id) WHERE status NOT IN ('completed', 'failed')"),
    "term_match": (term_match, f"WITH {PAPERS}, t AS (SELECT paper_id, unnest({_TERMS}) AS term FROM papers) SELECT paper_id, count(*) AS hits FROM t WHERE term IN ('the', 'of', 'tion') GROUP BY 1 HAVING count(DISTINCT term) = 3"),
    "topic_counts": (topic_counts, f"WITH {TOPIC_PAPERS} SELECT topic_id, analysis_status, count(*) AS n FROM topic_papers GROUP BY ALL"),
    "next_position": (next_position, f"WITH {LINKS} SELECT o_orderkey AS paper_id, coalesce(max(position) + 1, 0) AS next FROM orders LEFT JOIN links ON paper_id = o_orderkey GROUP BY 1"),
    "generation_dedup": (generation_dedup, "SELECT o_custkey AS model, o_orderpriority AS provider, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'active' ELSE 'ready' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus = 'P' DESC, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC) = 1"),
    "analysis_text": (analysis_text, f"WITH {PAPERS}, c AS (SELECT conv_id AS paper_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations WHERE role <> 'system' GROUP BY 1) SELECT paper_id, sha256(coalesce(body, abstract)) AS hash, length(coalesce(body, abstract))::INT AS n FROM papers LEFT JOIN c USING (paper_id)"),
    "batches_of_n": (batches_of_n, f"WITH {TOPIC_PAPERS} SELECT topic_id, paper_id, ((row_number() OVER (PARTITION BY topic_id ORDER BY paper_id) - 1) // 10)::INT AS batch FROM topic_papers"),
    "batch_progress": (batch_progress, f"WITH {JOB_EVENTS}, b AS (SELECT job_id AS batch, count(*) AS total, count(*) FILTER (WHERE kind IN ('completed', 'failed')) AS finished, count(*) FILTER (WHERE kind = 'failed') AS failed, coalesce(string_agg('paper ' || event_id || ': ' || props, '; ' ORDER BY event_id) FILTER (WHERE kind = 'failed'), '') AS failures FROM job_events GROUP BY 1) SELECT *, round(0.35::DOUBLE + 0.30::DOUBLE * finished / total, 6) AS progress, finished = total AS done FROM b"),
    "job_metrics": (job_metrics, f"WITH {JOB_EVENTS}, p AS (SELECT job_id, count(*) FILTER (WHERE kind = 'enqueued') AS e, count(*) FILTER (WHERE kind = 'delivered') AS d, count(*) FILTER (WHERE kind = 'completed') AS c, count(*) FILTER (WHERE kind = 'failed') AS f FROM job_events GROUP BY 1) SELECT sum(c)::BIGINT AS processed, sum(f)::BIGINT AS failed_attempts, sum(least(f, 2))::BIGINT AS retries, count(*) FILTER (WHERE f >= 3) AS terminal, sum(greatest(e - d, 0))::BIGINT AS queued, sum(greatest(d - c - f, 0))::BIGINT AS active FROM p"),
    "request_metrics": (request_metrics, "WITH l AS (SELECT user_id % 3 AS service, event_type AS operation, CASE WHEN event_id % 17 = 0 THEN 429 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END AS status, event_id % 4 AS attempt, value AS ms, event_id % 19 = 0 AS rejected FROM events) SELECT service, operation, count(*) AS requests, count(*) FILTER (WHERE status = 429) AS throttled, count(*) FILTER (WHERE attempt > 0) AS retried, count(*) FILTER (WHERE rejected) AS rejected, round(avg(ms), 6) AS mean_ms, count(*) FILTER (WHERE status >= 500) AS server_errors FROM l GROUP BY ALL"),
    "duration_quantiles": (duration_quantiles, "SELECT user_id % 3 AS service, count(*) AS requests, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY 1"),
    "token_usage": (token_usage, "WITH c AS (SELECT conv_id, role, len(string_split(text, ' ')) AS n FROM conversations) SELECT conv_id, coalesce(sum(n) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS input_tokens, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output_tokens, sum(n)::BIGINT AS total_tokens FROM c GROUP BY 1"),
    "quota_usage": (quota_usage, "WITH m AS (SELECT date_trunc('minute', ts) AS m, count(*) AS calls FROM events GROUP BY 1), d AS (SELECT date_trunc('day', m) AS day, sum(calls)::BIGINT AS day_calls FROM m GROUP BY 1) SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, calls, day_calls, calls > 2 AS over_minute, day_calls > 300 AS over_day FROM m JOIN d ON date_trunc('day', m.m) = d.day"),
    "readiness": (readiness, "WITH e AS (SELECT user_id AS probe, event_type AS dependency, CASE WHEN max(value) > 190 THEN 'down' ELSE 'ok' END AS state FROM events GROUP BY ALL) SELECT probe, bool_and(state = 'ok') AS ready, count(*)::INT AS n, string_agg(dependency || '=' || state, ',' ORDER BY dependency) AS states FROM e GROUP BY 1"),
}
