"""Views over the test tables that stand in for the engine's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    venue = F.when(F.col("doc_id") % 4 == 1, "Journal of X").when(F.col("doc_id") % 4 == 2, "Proceedings of Y").when(F.col("doc_id") % 4 == 3, "Z")
    return d.select(
        F.col("source").alias("topic_id"),
        F.col("doc_id").alias("paper_id"),
        F.array_join(F.slice(F.split("text", "[ \n]+", 9), 1, 8), " ").alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 2 == 0, "semantic_scholar").otherwise("arxiv").alias("source"),
        F.col("doc_id").cast("string").alias("external_id"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"),
        venue.alias("venue"),
        F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string")).alias("doi"),
        F.col("n_chars"),
    )


PAPERS = """papers AS (SELECT source AS topic_id, doc_id AS paper_id,
  array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 8), ' ') AS title, text AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN 'semantic_scholar' ELSE 'arxiv' END AS source, doc_id::VARCHAR AS external_id,
  (2000 + doc_id % 25)::INT AS year,
  CASE doc_id % 4 WHEN 1 THEN 'Journal of X' WHEN 2 THEN 'Proceedings of Y' WHEN 3 THEN 'Z' END AS venue,
  '10.1000/' || doc_id::VARCHAR AS doi, n_chars FROM documents)"""


def topic_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("topic_id"), F.col("doc_id").alias("paper_id"), F.round(F.col("n_chars") / 33047.0, 6).alias("score"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("hit"), "quality", "toxic")
    joined = d.join(done, "paper_id", "left")
    return joined.select("topic_id", "paper_id", "score", F.when(F.col("hit").isNotNull(), "completed").otherwise("pending").alias("analysis_status"), "quality", "toxic")


TOPIC_PAPERS = """topic_papers AS (SELECT d.source AS topic_id, d.doc_id AS paper_id, round(n_chars / 33047.0, 6) AS score,
  CASE WHEN l.doc_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS analysis_status, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper-author links: lineitem, one row per (order, supplier), the one with the smallest line number."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("position"))


LINKS = "links AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2)"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "enqueued").when(F.col("event_type") == "view", "delivered").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("created")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), kind.alias("kind"), "event_type", "value", "props")


JOB_EVENTS = """job_events AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'click' THEN 'enqueued' WHEN 'view' THEN 'delivered'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'created' END AS kind, event_type, value, props FROM events)"""
