"""Queries of upserts, deletes and table rules (D): old rows have even ids, the delta's ids are divisible by three."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as D
from ..sources import schemas
from .views import LINKS, PAPERS, TOPIC_PAPERS, job_events, links, papers, table, topic_papers


def _twice(delta: DataFrame, **first: Column) -> DataFrame:
    """Every row of a delta after an earlier row of the same key with other values."""
    return delta.withColumns(first).withColumn("ordinal", F.lit(1)).unionByName(delta.withColumn("ordinal", F.lit(2)))


def upsert_papers(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).select(F.col("paper_id").alias("id"), "source", "external_id", "title", "venue", "year").withColumn("created_at", F.lit(1))
    new = p.filter("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), "source", "external_id", F.reverse("title").alias("title"), F.lit(None).cast("string").alias("venue"), "year", F.lit(2).alias("created_at"))
    twice = _twice(new, title=F.concat(F.lit("draft "), "title"), id=F.col("id") + 1_000_000, created_at=F.lit(3))
    return D.upsert_papers(p.filter("id % 2 = 0"), twice)


def upsert_memberships(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf).select("topic_id", "paper_id", F.lit("a").alias("discovery_source"), "score")
    new = t.filter("paper_id % 3 = 0").select("topic_id", "paper_id", F.lit("b").alias("discovery_source"), F.lit(None).cast("double").alias("score"))
    return D.upsert_memberships(t.filter("paper_id % 2 = 0"), _twice(new, discovery_source=F.lit("c"), score=F.lit(0.25)))


def upsert_authors(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("author_id"), F.col("c_name").alias("name"), "c_custkey")
    delta = c.filter("c_custkey % 3 = 0").select("author_id", F.concat(F.lit(" "), F.upper("name")).alias("name"), F.col("c_custkey").alias("ordinal"))
    return D.upsert_authors(c.filter("c_custkey % 2 = 0").select("author_id", "name"), delta)


def linked_authors(spark: SparkSession, sf: str) -> DataFrame:
    own = links(spark, sf).filter("author_id % 2 = 0").withColumn("position", F.col("position").cast("int"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))
    new = links(spark, sf).filter("author_id % 3 = 0").join(names, "author_id").select("paper_id", "author_id", F.when(F.col("author_id") % 7 != 0, F.col("name")).otherwise(" ").alias("name"), (F.col("position") * 100_000 + F.col("author_id")).alias("ordinal"))
    return D.link_authors(own, new)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("paper_id"), F.col("turn").cast("int").alias("chunk_index")).agg(F.min("text").alias("text")).select(F.concat_ws("-", "paper_id", "chunk_index").alias("id"), F.lit("t").alias("topic_id"), "paper_id", F.lit("pdf").alias("chunk_type"), "chunk_index", "text", F.sha2("text", 256).alias("content_hash"), F.lit("completed").alias("embedding_status"), F.sha2("text", 256).alias("embedded_content_hash"), F.lit("p").alias("qdrant_point_id"))


_CHUNKS = "chunks AS (SELECT conv_id AS paper_id, turn::INT AS chunk_index, min(text) AS text FROM conversations GROUP BY 1, 2)"


def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    changed = F.when(F.col("chunk_index") % 2 == 1, F.reverse("text")).otherwise(F.col("text"))
    delta = c.filter("paper_id % 3 = 0").select("id", "topic_id", "paper_id", "chunk_type", "chunk_index", changed.alias("text"), F.sha2(changed, 256).alias("content_hash"))
    back = F.when(F.col("chunk_index") % 3 == 2, F.lit("other")).otherwise(F.col("content_hash"))  # changed, then changed back
    out = D.upsert_chunks(c.filter("paper_id % 2 = 0"), _twice(delta, content_hash=back))
    return out.select("paper_id", "chunk_index", "content_hash", "embedding_status", "embedded_content_hash", "qdrant_point_id")


def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    kept = _chunks(spark, sf).filter("paper_id % 2 = 0").groupBy("topic_id", "paper_id", "chunk_type").agg(F.lit(2).alias("n"))
    return D.delete_stale_chunks(_chunks(spark, sf), kept).select("paper_id", "chunk_index")


def topic_papers_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = links(spark, sf).select("paper_id", F.col("author_id").alias("topic_id"))
    left, _ = D.delete_topic_papers(table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id")), m, table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("topic_id")))
    return left


def topic_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf)
    gaps = t.filter("paper_id % 2 = 0").select("topic_id", F.col("paper_id").alias("id"))
    directions = t.filter("paper_id % 3 = 0").select(F.lit("src0").alias("owner"), F.col("paper_id").alias("id"), F.col("paper_id").alias("gap_id"))
    out = D.delete_topics({"gaps": gaps, "directions": directions}, table(spark, sf, "documents").filter("source IN ('src1', 'src2')").select(F.col("source").alias("topic_id")).distinct())
    return out["directions"].select("id", "gap_id").withColumn("kind", F.lit("direction")).unionByName(out["gaps"].select("id", F.lit(None).cast("long").alias("gap_id"), F.lit("gap").alias("kind")))


def upsert_titled(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).groupBy("topic_id", "title").agg(F.min("paper_id").alias("id"), F.max("year").alias("description"))
    new = p.filter("id % 3 = 0").select("topic_id", "title", (F.col("id") * 10).alias("id"), (F.col("description") + 1).alias("description"))
    return D.upsert_titled(p.filter("id % 2 = 0"), _twice(new, id=F.col("id") + 5, description=F.lit(0)))


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).select("paper_id", F.sha2("abstract", 256).alias("pdf_hash"), F.lit("completed").alias("status"))
    return D.upsert_documents(p.filter("paper_id % 2 = 0"), _twice(p.filter("paper_id % 3 = 0").withColumn("status", F.lit("failed")), status=F.lit("running")))


def upsert_tasks(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).select(F.col("topic_id").alias("collection_name"), F.col("external_id").alias("point_id"), F.lit("old").alias("reason"), F.when(F.col("paper_id") % 4 == 0, "completed").otherwise("failed").alias("status"), F.lit(3).alias("attempts"), F.lit("e").alias("error_message"), "paper_id")
    cols = ["collection_name", "point_id", "reason", "status", "attempts", "error_message"]
    new = p.filter("paper_id % 3 = 0").select("collection_name", "point_id", F.lit("new").alias("reason"), F.lit("pending").alias("status"))
    return D.upsert_cleanup_tasks(p.filter("paper_id % 2 = 0").select(*cols), _twice(new, reason=F.lit("older")))


def stage_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf)
    rows = lambda k: e.filter(k).groupBy(F.col("job_id").alias("run_id"), F.col("kind").alias("stage")).agg(F.max("event_id").alias("started_at"))
    old = rows("event_id % 2 = 0").select("run_id", "stage", F.lit("completed").alias("status"), F.lit(1).alias("attempt"), "started_at", F.col("started_at").alias("completed_at"), F.lit("x").alias("error_message"))
    return D.start_stages(old, rows("event_id % 3 = 0"))


def topic_state(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    topics = d.select(F.col("doc_id").alias("topic_id"), F.lit("processing").alias("status"), F.lit("ranking").alias("current_stage"), F.lit(0.25).alias("progress"), F.lit(None).cast("string").alias("error_message"), F.when(F.col("doc_id") % 4 == 0, 7).cast("int").alias("completed_at"))
    delta = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("topic_id"), F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("completed").alias("status"), F.lit("report").alias("current_stage"), F.lit(1.0).alias("progress"), F.when(F.col("doc_id") % 6 == 0, "bad").alias("error_message"), F.lit(9).alias("at"))
    return D.update_topics(topics, delta)


def column_updates(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf).select("topic_id", "paper_id", "score", "analysis_status")
    return D.update_columns(t, t.filter("paper_id % 3 = 0").select("topic_id", "paper_id", F.lit(0.5).alias("score"), F.lit("completed").alias("analysis_status")), ["topic_id", "paper_id"], ["score", "analysis_status"])


_IDENTITY = {"provider": "p", "model": "m", "dimensions": 8, "instruction_version": "q", "indexing_version": "v2"}


def chunk_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Started, finished and, for every seventh paper, moved to a new generation, which knows an old text of odd chunks."""
    none = F.lit(None).cast("string")
    c = _chunks(spark, sf).withColumns({"embedding_status": F.lit("pending"), "embedded_content_hash": none, "embedding_model": none, "qdrant_collection": none, "error_message": F.lit("late")})
    point = F.concat(F.lit("p"), F.col("id"))
    begun = D.start_embedding(c, c.filter("paper_id % 2 = 0").select("id", point.alias("point_id")), _IDENTITY, "c1")
    done = D.finish_embedding(begun, c.filter("paper_id % 3 = 0").select("id", F.when(F.col("chunk_index") % 2 == 0, point).otherwise("other").alias("point_id")))
    moved = c.filter("paper_id % 7 = 0").select("id", F.concat(F.lit("g"), "id").alias("point_id"), F.when(F.col("chunk_index") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    out = D.activate_generation(done, moved, _IDENTITY | {"model": "n"}, "c2")
    return out.select("id", "embedding_status", "qdrant_point_id", "embedded_content_hash", "embedding_model", "qdrant_collection", "error_message")


def backfills(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf)
    legacy = papers(spark, sf).select("topic_id", "paper_id", "source", F.when(F.col("paper_id") % 2 == 0, "{}").alias("analysis"))
    new = D.backfill_memberships(legacy, t.filter("paper_id % 3 = 0"))
    done = t.filter("paper_id % 5 = 0").select("topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"))
    chunks = D.backfill_abstract_chunks(papers(spark, sf), t, done)
    return new.select(F.lit("membership").alias("kind"), "paper_id", F.col("analysis_status").alias("value")).unionByName(chunks.select(F.lit("chunk").alias("kind"), "paper_id", F.col("content_hash").alias("value")))


def status_remap(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "why").otherwise("").alias("error_message"))
    return D.remap_status(o, {"F": "failed", "O": "ready", "P": "building"}, "unknown error")


def expectations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    checks = {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice") >= 1000}
    return D.violations(o, "orders", "o_orderkey", checks, {"day_customer": ["o_custkey", "o_orderpriority"]}, {"customer": ("o_custkey", table(spark, sf, "customer").filter("c_custkey % 10 != 0"), "c_custkey")})


def table_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and memberships against the declared rules of their tables, references to topics and papers included."""
    p = papers(spark, sf)
    topics = schemas.empty(spark, "research_topics").unionByName(p.filter("topic_id != 'src3'").select(F.col("topic_id").alias("id")).distinct(), allowMissingColumns=True)
    known = schemas.empty(spark, "papers").unionByName(p.filter("paper_id % 4 != 0").select(F.col("paper_id").cast("string").alias("id")), allowMissingColumns=True)
    rows = p.select("topic_id", F.col("paper_id").cast("string").alias("paper_id"), F.when(F.col("paper_id") % 5 == 0, "odd").otherwise("pending").alias("analysis_status"))
    members = schemas.empty(spark, "topic_papers").unionByName(rows, allowMissingColumns=True)
    return schemas.check_table(members, "topic_papers", {"research_topics": topics, "papers": known})


def stamped(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit(1).alias("updated_at"))
    new = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(F.col("c_name")))
    return D.stamp_updated(new, c.filter("c_custkey % 3 != 0"), ["c_custkey"], F.lit(2)).select("c_custkey", "updated_at")


def new_topics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("queries"))
    return D.new_topics(d.select(F.col("source").alias("topic_id"), F.concat(F.lit("topic "), F.col("source")).alias("topic"), "queries"))


def tables_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.conf.get("spark.checkpoint.dir", None)
    store = D.TableStore(spark, f"{base.rstrip('/')}/store-{spark.sparkContext.applicationId}-{id(sf)}" if base else tempfile.mkdtemp(prefix="spark-"))
    p = papers(spark, sf).select("paper_id", "title", "year")
    first = store.commit("papers", p.filter("paper_id % 2 = 0"))
    store.commit("papers", D.upsert(store.read("papers"), p.filter("paper_id % 3 = 0").withColumn("year", F.lit(1)), ["paper_id"], {}))
    return store.read("papers").join(store.read("papers", first).select("paper_id", F.col("year").alias("before")), "paper_id", "left")


_OD = "o AS (SELECT *, paper_id AS id FROM papers WHERE paper_id % 2 = 0), d AS (SELECT *, paper_id AS id FROM papers WHERE paper_id % 3 = 0)"
QUERIES = {
    "upsert_papers": (upsert_papers, f"WITH {PAPERS} SELECT CASE WHEN paper_id % 2 = 0 THEN paper_id ELSE paper_id + 2000000 END AS id, source, external_id, CASE WHEN paper_id % 3 = 0 THEN reverse(title) ELSE title END AS title, CASE WHEN paper_id % 3 <> 0 THEN venue END AS venue, year, CASE WHEN paper_id % 2 = 0 THEN 1 ELSE 3 END AS created_at FROM papers WHERE paper_id % 2 = 0 OR paper_id % 3 = 0"),
    "upsert_memberships": (upsert_memberships, f"WITH {TOPIC_PAPERS} SELECT topic_id, paper_id, CASE WHEN paper_id % 3 = 0 THEN 'b' ELSE 'a' END AS discovery_source, CASE WHEN paper_id % 2 = 0 THEN score ELSE 0.25 END AS score FROM topic_papers WHERE paper_id % 2 = 0 OR paper_id % 3 = 0"),
    "upsert_authors": (upsert_authors, "SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS author_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' || upper(c_name) ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "linked_authors": (linked_authors, f"WITH {LINKS}, o AS (SELECT paper_id, author_id, position::INT AS position FROM links WHERE author_id % 2 = 0), n AS (SELECT paper_id, author_id, row_number() OVER (PARTITION BY paper_id ORDER BY position * 100000 + author_id) - 1 AS k FROM links WHERE author_id % 3 = 0 AND author_id % 7 <> 0), m AS (SELECT paper_id, max(position) + 1 AS nxt FROM o GROUP BY 1) SELECT * FROM o UNION ALL SELECT n.paper_id, n.author_id, (coalesce(nxt, 0) + k)::INT FROM n LEFT JOIN m USING (paper_id) WHERE n.author_id % 2 <> 0"),
    "chunk_upsert": (chunk_upsert, f"WITH {_CHUNKS}, c AS (SELECT *, paper_id % 3 = 0 AND chunk_index % 2 = 1 AS changed FROM chunks WHERE paper_id % 2 = 0 OR paper_id % 3 = 0), h AS (SELECT *, sha256(CASE WHEN changed THEN reverse(text) ELSE text END) AS nh, paper_id % 2 = 0 AND (NOT changed OR reverse(text) = text) AND NOT (paper_id % 3 = 0 AND chunk_index % 3 = 2) AS keep FROM c) SELECT paper_id, chunk_index, nh AS content_hash, CASE WHEN keep THEN 'completed' ELSE 'pending' END AS embedding_status, CASE WHEN keep THEN sha256(text) END AS embedded_content_hash, CASE WHEN keep THEN 'p' END AS qdrant_point_id FROM h"),
    "stale_chunks": (stale_chunks, f"WITH {_CHUNKS} SELECT paper_id, chunk_index FROM chunks WHERE paper_id % 2 <> 0 OR chunk_index < 2"),
    "topic_papers_delete": (topic_papers_delete, f"WITH {LINKS} SELECT DISTINCT o_orderkey AS paper_id FROM orders JOIN links ON paper_id = o_orderkey WHERE author_id % 2 <> 0"),
    "topic_delete": (topic_delete, f"WITH {TOPIC_PAPERS} SELECT paper_id AS id, CASE WHEN paper_id % 2 = 0 AND topic_id NOT IN ('src1', 'src2') THEN paper_id END AS gap_id, 'direction' AS kind FROM topic_papers WHERE paper_id % 3 = 0 UNION ALL SELECT paper_id, NULL, 'gap' FROM topic_papers WHERE paper_id % 2 = 0 AND topic_id NOT IN ('src1', 'src2')"),
    "upsert_titled": (upsert_titled, f"WITH {PAPERS}, p AS (SELECT topic_id, title, min(paper_id) AS id, max(year) AS description FROM papers GROUP BY 1, 2) SELECT topic_id, title, CASE WHEN id % 2 = 0 THEN id ELSE id * 10 + 5 END AS id, CASE WHEN id % 3 = 0 THEN description + 1 ELSE description END AS description FROM p WHERE id % 2 = 0 OR id % 3 = 0"),
    "upsert_documents": (upsert_documents, f"WITH {PAPERS} SELECT paper_id, sha256(abstract) AS pdf_hash, CASE WHEN paper_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM papers WHERE paper_id % 2 = 0 OR paper_id % 3 = 0"),
    "upsert_tasks": (upsert_tasks, f"WITH {PAPERS} SELECT topic_id AS collection_name, external_id AS point_id, CASE WHEN paper_id % 3 = 0 THEN 'new' ELSE 'old' END AS reason, CASE WHEN paper_id % 4 = 0 THEN 'completed' WHEN paper_id % 3 = 0 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN paper_id % 2 = 0 THEN 3 ELSE 0 END AS attempts, CASE WHEN paper_id % 3 <> 0 THEN 'e' END AS error_message FROM papers WHERE paper_id % 2 = 0 OR paper_id % 3 = 0"),
    "stage_upsert": (stage_upsert, "WITH e AS (SELECT event_id, user_id AS run_id, CASE event_type WHEN 'click' THEN 'enqueued' WHEN 'view' THEN 'delivered' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'created' END AS stage FROM events), o AS (SELECT run_id, stage, max(event_id) AS m FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2), d AS (SELECT run_id, stage, max(event_id) AS n FROM e WHERE event_id % 3 = 0 GROUP BY 1, 2) SELECT run_id, stage, CASE WHEN n IS NOT NULL THEN 'running' ELSE 'completed' END AS status, CASE WHEN m IS NOT NULL AND n IS NOT NULL THEN 2 ELSE 1 END AS attempt, coalesce(n, m) AS started_at, CASE WHEN n IS NULL THEN m END AS completed_at, CASE WHEN n IS NULL THEN 'x' END AS error_message FROM o FULL JOIN d USING (run_id, stage)"),
    "topic_state": (topic_state, "SELECT doc_id AS topic_id, CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'report' ELSE 'ranking' END AS current_stage, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS progress, CASE WHEN doc_id % 6 = 0 THEN 'bad' END AS error_message, CASE WHEN doc_id % 4 = 0 THEN 7 WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 9 END AS completed_at FROM documents"),
    "column_updates": (column_updates, f"WITH {TOPIC_PAPERS} SELECT topic_id, paper_id, CASE WHEN paper_id % 3 = 0 THEN 0.5 ELSE score END AS score, CASE WHEN paper_id % 3 = 0 THEN 'completed' ELSE analysis_status END AS analysis_status FROM topic_papers"),
    "chunk_transitions": (chunk_transitions, f"WITH {_CHUNKS}, c AS (SELECT paper_id || '-' || chunk_index AS id, *, paper_id % 6 = 0 AND chunk_index % 2 = 0 AS done, paper_id % 2 = 0 AS begun, paper_id % 7 = 0 AND chunk_index % 2 = 0 AS moved FROM chunks) SELECT id, CASE WHEN done OR moved THEN 'completed' WHEN begun THEN 'indexing' ELSE 'pending' END AS embedding_status, CASE WHEN moved THEN 'g' || id WHEN begun THEN 'p' || id ELSE 'p' END AS qdrant_point_id, CASE WHEN done OR moved THEN sha256(text) END AS embedded_content_hash, CASE WHEN moved THEN 'n' WHEN begun THEN 'm' END AS embedding_model, CASE WHEN moved THEN 'c2' WHEN begun THEN 'c1' END AS qdrant_collection, CASE WHEN NOT (begun OR moved) THEN 'late' END AS error_message FROM c"),
    "backfills": (backfills, f"WITH {PAPERS} SELECT 'membership' AS kind, paper_id, CASE WHEN paper_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS value FROM papers WHERE paper_id % 3 <> 0 UNION ALL SELECT 'chunk', paper_id, sha256(abstract) FROM papers WHERE paper_id % 5 <> 0 AND trim(abstract) <> ''"),
    "status_remap": (status_remap, "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready' ELSE 'building' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'why' WHEN o_orderstatus = 'F' THEN 'unknown error' ELSE '' END AS error_message FROM orders"),
    "expectations": (expectations, "SELECT 'orders' AS table_name, 'status' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'orders', 'price', o_orderkey::VARCHAR FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT 'orders', 'day_customer', o_custkey || '|' || o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1 UNION ALL SELECT 'orders', 'customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"),
    "table_rules": (table_rules, "SELECT 'topic_papers' AS table_name, 'analysis_status value' AS rule, source AS key FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'topic_papers', 'topic_id not in research_topics', source FROM documents WHERE source = 'src3' UNION ALL SELECT 'topic_papers', 'paper_id not in papers', source FROM documents WHERE doc_id % 4 = 0"),
    "stamped": (stamped, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 2 ELSE 1 END AS updated_at FROM customer"),
    "new_topics": (new_topics, "SELECT source AS topic_id, 'topic ' || source AS topic, '[' || string_agg(DISTINCT '\"' || lang || '\"', ',' ORDER BY '\"' || lang || '\"') || ']' AS expanded_queries, 'pending' AS status, 'pending' AS current_stage, 0.0::DOUBLE AS progress FROM documents GROUP BY source"),
    "tables_roundtrip": (tables_roundtrip, f"WITH {PAPERS} SELECT paper_id, title, CASE WHEN paper_id % 3 = 0 THEN 1 ELSE year END AS year, CASE WHEN paper_id % 2 = 0 THEN year END AS before FROM papers WHERE paper_id % 2 = 0 OR paper_id % 3 = 0"),
}
