"""Queries of discovery and entity resolution (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as C
from ..sources.records import read_search_json
from .views import PAPERS, job_events, papers, table, topic_papers


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Papers and, for every fifth, a twin from the other source with a changed title and the DOI as a URL."""
    p = papers(spark, sf)
    none = F.lit(None).cast("string")
    authors = F.array(F.struct(F.concat(F.lit("Author "), (F.col("paper_id") % 7).cast("string")).alias("name"), none.alias("author_id")))
    base = p.select("topic_id", F.col("paper_id").alias("ordinal"), F.col("external_id").alias("id"), "title", "abstract", "source", "external_id", F.lit("").alias("url"), F.lit("").alias("pdf_url"), "year", "venue", F.when(F.col("paper_id") % 3 != 0, F.col("doi")).otherwise("").alias("doi"), F.lit("").alias("arxiv_id"), authors.alias("authors"))
    k = F.col("ordinal")
    other = F.when(F.col("source") == "arxiv", "semantic_scholar").otherwise("arxiv")
    twin = base.filter(k % 5 == 0).withColumns({"title": F.concat("title", F.lit("!")), "source": other, "pdf_url": F.concat(F.lit("http://x/"), "external_id"), "doi": F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).otherwise(""), "external_id": F.concat(F.lit("t"), "external_id"), "ordinal": k + 1_000_000, "authors": F.array(F.struct(F.concat(F.lit("author "), (k % 7).cast("string")).alias("name"), F.col("external_id").alias("author_id")), F.struct(F.lit("Other").alias("name"), none.alias("author_id")))})
    return base.unionByName(twin)


def quota_plan(spark: SparkSession, sf: str) -> DataFrame:
    q = papers(spark, sf).select("topic_id", F.col("paper_id").alias("position"), F.col("external_id").alias("query"))
    return C.allocate_quota(q, 50)


def relaxed_queries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.slice(F.split("text", "[ \n]+"), 1, (F.col("doc_id") % 7 + 1).cast("int")).alias("q"), F.slice(F.split("text", "[ \n]+"), 1, (F.col("doc_id") % 5 + 1).cast("int")).alias("k"), "source")
    q, k = C.relaxed(F.col("q"), F.col("k"), F.col("source"), "broad")
    return d.select("doc_id", F.array_join(q, " ").alias("queries"), F.array_join(k, " ").alias("keywords"))


def fallback_level(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf).withColumn("level", (F.col("event_id") % 3).cast("int"))
    found = e.groupBy(F.col("job_id").alias("topic_id"), "level").agg(F.count("*").alias("papers"), (F.max("value") < 190).alias("ok"))
    return C.pick_level(found, 22)


def reconcile_closure(spark: SparkSession, sf: str) -> DataFrame:
    return C.reconcile_closure(_records(spark, sf)).select("topic_id", "ordinal", "members", "source", "title", "pdf_url", "doi")


def reconcile_loop(spark: SparkSession, sf: str) -> DataFrame:
    return C.reconcile(_records(spark, sf)).select("topic_id", "ordinal", "source", "title", "pdf_url", "doi", F.size("authors").alias("authors"))


def shared_authors(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    a = r.filter("ordinal < 1000000").select("ordinal", F.col("authors").alias("a"))
    b = r.filter("ordinal >= 1000000").select((F.col("ordinal") - 1_000_000 + 5).alias("ordinal"), F.col("authors").alias("b"))
    return a.join(b, "ordinal").select("ordinal", C.shared_author(F.col("a"), F.col("b")).alias("shared"))


def merged_papers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).withColumn("paper", F.col("ordinal") % 1_000_000)
    out = C.merged_authors(rows)
    return out.select("topic_id", "paper", F.array_join(F.transform("authors", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["author_id"], F.lit("")))), ";").alias("authors"))


def capped_papers(spark: SparkSession, sf: str) -> DataFrame:
    return C.cap_papers(_records(spark, sf), 20).select("topic_id", "ordinal")


def search_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf).select(F.concat(F.col("job_id").cast("string"), F.lit("-"), (F.col("event_id") % 9).cast("string")).alias("topic_id"), (F.col("event_id") % 4 == 0).alias("ok"), F.col("kind").alias("error"))
    return C.search_outcome(e)


def batch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf).select(F.col("job_id").alias("batch"), (F.col("kind") != "failed").alias("ok"), F.col("kind").alias("kind"), F.col("event_id").alias("id"), F.lit("x").alias("cause"))
    out = C.batch_outcome(e, "store papers")
    return out.select("batch", "total", "succeeded", "message", F.array_join(F.transform("failures", lambda x: x["id"].cast("string")), ",").alias("failed"))


def min_papers(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf)
    return C.min_papers_gate(t.select("topic_id").distinct(), t.filter("analysis_status = 'completed'"), 20)


def citation_degrees(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_suppkey").alias("cited"))
    return C.citation_degrees(lines, C.spread(lines))


def citations_from_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a search hit whose references are the suppliers of its lines, read from JSON."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"))
    parts = C.spread(lines)
    cited = lines.repartition(parts, "paper_id").distinct().groupBy("paper_id").agg(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("author_id").cast("string")).alias("paperId"))).alias("references"))
    hit = F.struct(F.concat(F.lit("o"), F.col("paper_id").cast("string")).alias("paperId"), "references")
    pages = cited.select(F.col("paper_id").alias("page"), F.to_json(F.struct(F.lit(1).alias("total"), F.array(hit).alias("data"))).alias("payload"))
    return C.citation_degrees(C.citation_edges(read_search_json(pages, ["page"]), parts), parts)


_REC = f"""{PAPERS}, r AS (SELECT topic_id, paper_id AS ordinal, paper_id AS k, title, source, CASE WHEN paper_id % 3 <> 0 THEN doi ELSE '' END AS doi, '' AS pdf FROM papers
  UNION ALL SELECT topic_id, paper_id + 1000000, paper_id, title || '!', CASE WHEN source = 'arxiv' THEN 'semantic_scholar' ELSE 'arxiv' END, CASE WHEN paper_id % 3 <> 0 THEN 'https://doi.org/' || doi ELSE '' END, 'http://x/' || external_id FROM papers WHERE paper_id % 5 = 0)"""
_CLOSURE = f"""WITH RECURSIVE {_REC}, n AS (SELECT r.*, trim(regexp_replace(lower(r.title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM r),
key AS (SELECT topic_id, ordinal, CASE WHEN k % 3 <> 0 THEN 'd' || k ELSE 'e' || source || CASE WHEN ordinal >= 1000000 THEN 't' ELSE '' END || k END AS key FROM n
  UNION ALL SELECT topic_id, ordinal, t || '|' || k % 25 || '|author ' || k % 7 FROM n WHERE t <> ''
  UNION ALL SELECT topic_id, ordinal, t || '|' || k % 25 || '|other' FROM n WHERE t <> '' AND ordinal >= 1000000),
edge AS (SELECT DISTINCT x.ordinal AS a, y.ordinal AS b FROM key x JOIN key y ON x.topic_id = y.topic_id AND x.key = y.key),
reach AS (SELECT DISTINCT a AS a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS ordinal, min(b) AS root FROM reach GROUP BY 1), m AS (SELECT r.*, coalesce(root, r.ordinal) AS root FROM r LEFT JOIN c USING (ordinal))
SELECT topic_id, min(ordinal) AS ordinal, count(*) AS members, arg_min(source, ordinal) AS source, arg_min(title, ordinal) FILTER (WHERE title <> '') AS title,
  arg_min(pdf, ordinal) FILTER (WHERE pdf <> '') AS pdf_url, arg_min(doi, ordinal) FILTER (WHERE doi <> '') AS doi FROM m GROUP BY topic_id, root"""
_EV = "e AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'enqueued' WHEN 'view' THEN 'delivered' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'created' END AS kind, value FROM events)"
_W = "regexp_split_to_array(text, '[ \\n]+')"
QUERIES = {
    "quota_plan": (quota_plan, f"WITH {PAPERS}, q AS (SELECT topic_id, external_id AS query, row_number() OVER (PARTITION BY topic_id ORDER BY paper_id) - 1 AS k FROM papers QUALIFY k < 50), n AS (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM q) SELECT topic_id, query, (50 // n + CASE WHEN k < 50 % n THEN 1 ELSE 0 END)::INT AS quota, unnest(['semantic_scholar', 'arxiv']) AS source FROM n"),
    "relaxed_queries": (relaxed_queries, f"WITH d AS (SELECT doc_id, source, list_slice({_W}, 1, doc_id % 7 + 1) AS q, list_slice({_W}, 1, doc_id % 5 + 1) AS k FROM documents) SELECT doc_id, CASE WHEN len(q) <= 1 THEN source ELSE array_to_string(list_slice(q, 1, greatest(2, len(q) // 2)), ' ') END AS queries, CASE WHEN len(k) <= 2 THEN '' ELSE array_to_string(list_slice(k, 1, greatest(1, len(k) // 2)), ' ') END AS keywords FROM d"),
    "fallback_level": (fallback_level, f"WITH {_EV}, f AS (SELECT user_id AS topic_id, (event_id % 3)::INT AS level, count(*) AS papers, max(value) < 190 AS ok FROM e GROUP BY ALL) SELECT topic_id, coalesce(min(level) FILTER (WHERE papers >= 22 AND ok), max(level)) AS level FROM f GROUP BY 1"),
    "reconcile_closure": (reconcile_closure, _CLOSURE),
    "reconcile_loop": (reconcile_loop, None),
    "shared_authors": (shared_authors, "SELECT a.doc_id AS ordinal, a.doc_id % 7 = b.doc_id % 7 AS shared FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 5 WHERE b.doc_id % 5 = 0"),
    "merged_papers": (merged_papers, "SELECT source AS topic_id, doc_id AS paper, 'Author ' || doc_id % 7 || ':' || CASE WHEN doc_id % 5 = 0 THEN doc_id || ';Other:' ELSE '' END AS authors FROM documents"),
    "capped_papers": (capped_papers, f"WITH {_REC} SELECT topic_id, ordinal FROM r QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY ordinal) <= 20"),
    "search_outcome": (search_outcome, f"WITH {_EV} SELECT user_id || '-' || event_id % 9 AS topic_id, count(*) FILTER (WHERE event_id % 4 = 0) AS succeeded, count(*) AS total, CASE WHEN count(*) FILTER (WHERE event_id % 4 = 0) = 0 THEN string_agg(DISTINCT kind, '; ' ORDER BY kind) END AS error FROM e GROUP BY 1"),
    "batch_outcome": (batch_outcome, f"WITH {_EV} SELECT user_id AS batch, count(*) AS total, count(*) FILTER (WHERE kind <> 'failed') AS succeeded, CASE WHEN count(*) FILTER (WHERE kind = 'failed') > 0 THEN 'store papers completed with ' || count(*) FILTER (WHERE kind <> 'failed') || '/' || count(*) || ' successful: ' || string_agg('failed ' || event_id || ': x', '; ' ORDER BY event_id) FILTER (WHERE kind = 'failed') END AS message, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE kind = 'failed'), '') AS failed FROM e GROUP BY 1"),
    "min_papers": (min_papers, "WITH c AS (SELECT d.source AS topic_id, count(l.doc_id) AS papers FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1) SELECT topic_id, papers, 'found ' || papers || ' papers, need 20' AS message FROM c WHERE papers < 20"),
    "citations_from_payloads": (citations_from_payloads, "WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM u GROUP BY 1"),
    "citation_degrees": (citation_degrees, "WITH e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem), u AS (SELECT a AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM u GROUP BY 1"),
}
