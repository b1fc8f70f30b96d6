"""Queries of structured model output (H) and reports (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import judged as H
from ..operators import report as R
from .views import PAPERS, TOPIC_PAPERS, papers, table, topic_papers


def _analysis(short: bool = True) -> object:
    k = F.col("paper_id")
    body = F.col("title")
    return F.to_json(F.struct(F.when(k % 7 == 0, " ").otherwise(body).alias("problem_statement"), F.concat(F.lit("m"), k.cast("string")).alias("methodology"), F.lit("d").alias("dataset"), F.concat(F.lit("f"), k.cast("string")).alias("key_findings"), F.when(k % 11 != 0, F.lit("l")).alias("limitations"), F.lit("w").alias("future_work"), F.when(k % 13 == 0, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"))).alias("evaluation_metrics")))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    j = _analysis()
    k = F.col("paper_id")
    raw = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k % 17 == 0, F.substring(j, 1, 20)).otherwise(j)
    return papers(spark, sf).select("paper_id", raw.alias("raw"))


def analysis_valid(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.parse_outputs(_raw(spark, sf), "raw", H.ANALYSIS)
    fault = F.coalesce("error", H.analysis_fault(F.col("value"), F.col("raw")))
    return rows.select("paper_id", fault.alias("fault"))


def schema_infer(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).select("paper_id", _analysis().alias("raw"))
    return spark.range(1).select(F.lit(H.infer_schema(spark, rows, "raw")).alias("inferred"))


def output_misfits(spark: SparkSession, sf: str) -> DataFrame:
    return H.misfits(_raw(spark, sf), "raw", H.ANALYSIS).select("paper_id")


def rerank_valid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'view'")
    rows = e.select(F.col("user_id").alias("batch"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("index"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, 1.5).otherwise(0.5).alias("score"))
    sizes = rows.groupBy("batch").agg((F.max("index") + (F.col("batch") % 3 == 0).cast("int")).alias("n"))
    return H.rerank_faults(rows.withColumn("index", F.when((F.col("batch") % 5 == 0) & (F.col("index") == 2), 1).otherwise(F.col("index"))), sizes)


def gap_valid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("paper_id")
    p = papers(spark, sf)
    kind = F.when(k % 5 == 0, "other").otherwise("limitation")
    return p.select("paper_id", H.gap_fault(k, kind, F.when(k % 7 == 0, " ").otherwise(F.col("title")), F.when(k % 11 != 0, F.col("title")), F.when(k % 13 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("fault"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("topic_id").orderBy(F.desc("score"), "paper_id")
    return topic_papers(spark, sf).select("topic_id", "paper_id", "score", F.row_number().over(w).alias("rank"))


_RANKED = "ranked AS (SELECT topic_id, paper_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, paper_id)::INT AS rank FROM topic_papers)"


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = _ranked(spark, sf).filter("rank <= 3")
    second = F.when((F.col("topic_id") == "src3") & (F.col("rank") == 2), F.col("rank")).when((F.col("topic_id") == "src4") & (F.col("rank") == 1), 100_000_000).otherwise(F.col("rank") + 1)
    return g.select("topic_id", F.col("rank").alias("gap"), F.array(F.col("rank"), second).cast("array<int>").alias("evidence_indices"))


def gap_refs(spark: SparkSession, sf: str) -> DataFrame:
    out = H.resolve_gap_refs(_gaps(spark, sf), _ranked(spark, sf))
    return out.select("topic_id", "gap", "evidence")


def default_queries(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    q = F.when(F.col("paper_id") % 3 == 0, F.array(F.col("title"))).when(F.col("paper_id") % 3 == 1, F.array().cast("array<string>"))
    return p.select("paper_id", F.array_join(H.default_queries(F.col("topic_id"), q), "|").alias("queries"))


def feasibility(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("paper_id")
    g = papers(spark, sf).select("topic_id", "title", F.col("external_id").alias("description"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("")), (k % 4 + 1).cast("int")).alias("difficulty"), F.lit("1").alias("estimated_cost"), F.lit("v").alias("industry_viability"), F.lit("t").alias("time_to_mvp"), F.lit("go").alias("recommendation"), F.col("external_id").alias("evidence"))
    return H.directions(g)


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ranked(spark, sf).join(papers(spark, sf).select("paper_id", "title", "abstract"), "paper_id")
    topics = _topics(spark, sf)
    limited = rows.withColumn("limitations", F.substring("abstract", 1, 300))
    evidence = rows.filter("rank <= 3").select("topic_id", F.col("rank").alias("index"), F.col("abstract").alias("text"))
    kinds = {
        "expansion": H.expansion_prompts(topics).select(F.col("topic_id").alias("key"), "prompt"),
        "rerank": H.rerank_prompts(topics, rows).select(F.concat_ws("/", "topic_id", "batch").alias("key"), "prompt"),
        "analysis": H.analysis_prompts(rows.select("paper_id", F.col("abstract").alias("text"))).select(F.col("paper_id").cast("string").alias("key"), "prompt"),
        "gap": H.gap_prompts(topics, limited, evidence).select(F.col("topic_id").alias("key"), "prompt"),
        "feasibility": H.feasibility_prompts(_report_gaps(spark, sf)).select(F.concat_ws("/", "topic_id", "title").alias("key"), "prompt"),
    }
    out = None
    for kind, part in kinds.items():
        part = part.select(F.lit(kind).alias("kind"), "key", "prompt")
        out = part if out is None else out.unionByName(part)
    return out


def gap_evidence(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "conversations").join(table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("topic_id")), "conv_id").select("topic_id", F.col("conv_id").alias("paper_id"), "text", F.col("turn").alias("score"))
    return H.gap_evidence(hits, _ranked(spark, sf).filter("rank <= 20")).select("topic_id", "index", F.sha2("text", 256).alias("hash"), "score")


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf).select("topic_id", "paper_id", "score")
    p = papers(spark, sf).drop("topic_id").withColumn("analysis", F.when(F.col("paper_id") % 3 != 0, _analysis()).when(F.col("paper_id") % 2 == 0, "{broken"))
    authors = F.array(F.concat(F.lit("Author "), (F.col("paper_id") % 7).cast("string")))
    return t.join(p, "paper_id").withColumn("authors", authors)


def _report_gaps(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf).filter("rank <= 3 AND topic_id != 'src5'")
    return r.select("topic_id", F.col("rank").alias("ordinal"), F.lit("limitation").alias("gap_type"), F.concat(F.lit("Gap "), F.col("rank").cast("string")).alias("title"), F.when(F.col("rank") != 2, "why").alias("description"), F.when(F.col("rank") == 3, F.concat(F.col("paper_id").cast("string"), F.lit(", missing"))).otherwise(F.col("paper_id").cast("string")).alias("evidence"))


def _report_directions(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf).filter("rank <= 2")
    return r.select("topic_id", F.col("rank").alias("ordinal"), F.concat(F.lit("Direction "), F.col("rank").cast("string")).alias("title"), F.lit("d").alias("description"), F.when(F.col("rank") == 1, "low").otherwise("high").alias("difficulty"), F.lit(None).cast("string").alias("estimated_cost"), F.lit("v").alias("industry_viability"), F.lit("t").alias("time_to_mvp"), H.feasibility_score(F.when(F.col("rank") == 1, "low").otherwise("high")).alias("score"))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("topic_id")).distinct().withColumn("topic", F.concat(F.lit("topic "), "topic_id"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return R.assemble_report(_topics(spark, sf), _papers(spark, sf), _report_gaps(spark, sf), _report_directions(spark, sf), F.to_date(F.lit("2024-03-05")))


def paper_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return R.paper_summaries(_papers(spark, sf)).select("topic_id", "paper_id", "methodology", "key_findings", "limitations", "venue", "year", "score")


def gap_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return R.gap_summaries(_report_gaps(spark, sf))


def exec_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("topic_id", "executive_summary")


def literature_table(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("topic_id", "literature_review")


def bibtex(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("topic_id", "bibtex")


def report_md(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("topic_id", "markdown")


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("topic_id", "topic", "n_papers", "n_gaps", "n_directions")


def citation_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return R.citation_faults(_report_gaps(spark, sf), _papers(spark, sf))


_AN = "CASE WHEN paper_id % 3 <> 0 THEN {0} ELSE '' END"
QUERIES = {
    "analysis_valid": (analysis_valid, f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 5 <> 0 AND paper_id % 17 = 0 THEN 'no JSON' WHEN paper_id % 7 = 0 OR title = '' THEN 'problem_statement' WHEN paper_id % 11 = 0 THEN 'limitations' WHEN paper_id % 13 = 0 THEN 'evaluation_metrics' END AS fault FROM papers"),
    "schema_infer": (schema_infer, None),
    "output_misfits": (output_misfits, "SELECT doc_id AS paper_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 17 = 0"),
    "rerank_valid": (rerank_valid, "WITH r AS (SELECT user_id AS batch, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'view'), b AS (SELECT batch, count(*) AS c, bool_or(event_id % 97 = 0 OR event_id % 89 = 0) AS bad FROM r GROUP BY 1) SELECT batch, CASE WHEN bad THEN 'score' WHEN batch % 5 = 0 AND c >= 2 THEN 'duplicate' ELSE 'incomplete' END AS fault FROM b WHERE bad OR (batch % 5 = 0 AND c >= 2) OR batch % 3 = 0"),
    "gap_valid": (gap_valid, f"WITH {PAPERS}, g AS (SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN 'type' WHEN paper_id % 7 = 0 OR title = '' THEN 'title' WHEN paper_id % 11 = 0 THEN 'description' WHEN paper_id % 13 = 0 THEN 'evidence' END AS f FROM papers) SELECT paper_id, 'gap ' || paper_id || ': ' || f AS fault FROM g"),
    "gap_refs": (gap_refs, f"WITH {TOPIC_PAPERS}, {_RANKED} SELECT a.topic_id, a.rank AS gap, a.paper_id || ',' || b.paper_id AS evidence FROM ranked a JOIN ranked b ON a.topic_id = b.topic_id AND b.rank = a.rank + 1 WHERE a.rank <= 3 AND a.topic_id NOT IN ('src3', 'src4')"),
    "default_queries": (default_queries, f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN title ELSE topic_id END AS queries FROM papers"),
    "feasibility": (feasibility, f"WITH {PAPERS}, g AS (SELECT *, ['low', 'medium', 'high', ''][paper_id % 4 + 1] AS d FROM papers) SELECT topic_id, 'Research Direction: ' || title AS title, external_id || chr(10) || chr(10) || 'go' AS description, 'Based on gap analysis. Evidence: ' || external_id AS rationale, CASE d WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.3 ELSE 0.5 END::DOUBLE AS feasibility_score, nullif(d, '') AS implementation_complexity, '1' AS estimated_cost, 'v' AS industry_viability, 't' AS time_to_mvp FROM g"),
    "prompts": (prompts, None),
    "gap_evidence": (gap_evidence, f"WITH {TOPIC_PAPERS}, {_RANKED} SELECT r.topic_id, rank AS index, sha256(substr(text, 1, 500)) AS hash, turn AS score FROM conversations c JOIN ranked r ON r.paper_id = c.conv_id WHERE rank <= 20 AND trim(text) <> ''"),
    "paper_summaries": (paper_summaries, f"WITH {PAPERS} SELECT topic_id, paper_id, {_AN.format(chr(39) + 'm' + chr(39) + ' || paper_id')} AS methodology, {_AN.format(chr(39) + 'f' + chr(39) + ' || paper_id')} AS key_findings, CASE WHEN paper_id % 3 <> 0 AND paper_id % 11 <> 0 THEN 'l' ELSE '' END AS limitations, coalesce(venue, '') AS venue, year, round(n_chars / 33047.0, 6)::DOUBLE AS score FROM papers"),
    "gap_summaries": (gap_summaries, f"WITH {TOPIC_PAPERS}, {_RANKED} SELECT topic_id, rank AS ordinal, 'limitation' AS gap_type, 'Gap ' || rank AS title, CASE WHEN rank <> 2 THEN 'why' ELSE '' END AS description, paper_id || CASE WHEN rank = 3 THEN ', missing' ELSE '' END AS evidence FROM ranked WHERE rank <= 3 AND topic_id <> 'src5'"),
    "exec_summary": (exec_summary, f"WITH {TOPIC_PAPERS}, t AS (SELECT topic_id, count(*) AS n FROM topic_papers GROUP BY 1) SELECT topic_id, '# Executive Summary' || chr(10) || chr(10) || 'This report analyzes **' || n || '** academic papers related to: **topic ' || topic_id || '**' || chr(10) || chr(10) || CASE WHEN topic_id <> 'src5' THEN '### Research Gaps Identified: 3' || chr(10) || chr(10) || '- **Gap 1** (limitation): why' || chr(10) || '- **Gap 2** (limitation): ' || chr(10) || '- **Gap 3** (limitation): why' || chr(10) || chr(10) ELSE '' END || '### Research Directions Proposed: 2' || chr(10) || chr(10) || '- **Direction 1** (Difficulty: low, Score: 0.9)' || chr(10) || '- **Direction 2** (Difficulty: high, Score: 0.3)' || chr(10) || chr(10) || '*Report generated on March 5, 2024*' || chr(10) AS executive_summary FROM t WHERE n >= 3"),
    "literature_table": (literature_table, None),
    "bibtex": (bibtex, None),
    "report_md": (report_md, None),
    "report_rows": (report_rows, "SELECT source AS topic_id, 'topic ' || source AS topic, count(*) AS n_papers, CASE WHEN source = 'src5' THEN 0 ELSE least(3, count(*)) END AS n_gaps, least(2, count(*)) AS n_directions FROM documents GROUP BY source"),
    "citation_integrity": (citation_integrity, f"WITH {TOPIC_PAPERS}, {_RANKED} SELECT topic_id, 'missing' AS key, 'Gap 3' AS title FROM ranked WHERE rank = 3 AND topic_id <> 'src5'"),
}
