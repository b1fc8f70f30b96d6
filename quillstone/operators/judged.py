"""Structured model output: validation, resolution and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate_chars, unfence_json

ANALYSIS = "problem_statement string, methodology string, dataset string, key_findings string, limitations string, future_work string, evaluation_metrics array<string>"
_FIELDS = ["problem_statement", "methodology", "dataset", "key_findings", "limitations", "future_work"]
GAP_TYPES = ["unexplored", "conflicting", "limitation"]


def _blank(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "") == ""


def infer_schema(spark: SparkSession, outputs: DataFrame, column: str) -> str:
    """H1: the schema of a column of JSON responses, inferred over all of them."""
    agg = outputs.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()
    return agg["s"]


def misfits(outputs: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON does not parse to the schema."""
    parsed = F.from_json(F.col(column), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return outputs.withColumn("_p", parsed).filter("_p IS NULL OR _p._bad IS NOT NULL").drop("_p")


def parse_outputs(outputs: DataFrame, column: str, schema: str) -> DataFrame:
    """Unfenced and parsed; ``error`` tells why ``value`` is null."""
    own = outputs.withColumn("_j", unfence_json(F.col(column)))
    own = own.withColumn("value", F.from_json("_j", schema))
    return own.withColumn("error", F.when(F.col("_j").isNull(), "no JSON").when(F.col("value").isNull(), "other schema")).drop("_j")


def analysis_fault(value: Column, raw: Column, most_bytes: int = 16 * 1024) -> Column:
    """H2: the first thing wrong with an analysis; null if it is valid."""
    out = F.when(value.isNull(), "not an object")
    for f in _FIELDS:
        out = out.when(_blank(value[f]), f)
    metrics = value["evaluation_metrics"]
    out = out.when(metrics.isNull() | F.coalesce(F.exists(metrics, _blank), F.lit(False)), "evaluation_metrics")
    return out.when(F.octet_length(raw) > most_bytes, "size")


def rerank_faults(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """H3: ``(batch, fault)`` of batches whose scores are not exactly one finite value in [0, 1] per index."""
    j = sizes.join(scores, "batch", "left")
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    checks = j.groupBy("batch").agg(F.first("n").alias("n"), F.count("index").alias("c"), F.count_distinct("index").alias("d"), F.bool_or(~F.col("index").between(1, F.col("n"))).alias("out"), F.bool_or(bad).alias("bad"))
    fault = F.when(F.col("c") == 0, "empty").when(F.col("out"), "index").when(F.col("bad"), "score").when(F.col("d") < F.col("c"), "duplicate").when(F.col("c") < F.col("n"), "incomplete")
    return checks.select("batch", fault.alias("fault")).filter("fault IS NOT NULL")


def gap_fault(number: Column, gap_type: Column, title: Column, description: Column, evidence: Column) -> Column:
    """H4."""
    what = F.when(~F.coalesce(gap_type.isin(GAP_TYPES), F.lit(False)), "type").when(_blank(title), "title").when(_blank(description), "description").when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "evidence")
    return F.when(what.isNotNull(), F.concat(F.lit("gap "), number.cast("string"), F.lit(": "), what))


def resolve_gap_refs(gaps: DataFrame, ranked: DataFrame) -> DataFrame:
    """H5: 1-based indices to paper ids, order kept. One bad or repeated index rejects all gaps of the topic."""
    refs = gaps.select("topic_id", "gap", F.posexplode("evidence_indices").alias("pos", "index"))
    hit = refs.join(ranked.select("topic_id", F.col("rank").alias("index"), "paper_id"), ["topic_id", "index"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper_id"))), lambda x: x["paper_id"].cast("string"))
    per = hit.groupBy("topic_id", "gap").agg(ordered.alias("paper_ids"), ((F.count("paper_id") == F.count("*")) & (F.count_distinct("index") == F.count("*"))).alias("ok"))
    good = per.groupBy("topic_id").agg(F.bool_and("ok").alias("_all")).filter("_all")
    return per.join(good, "topic_id", "left_semi").select("topic_id", "gap", "paper_ids", F.array_join("paper_ids", ",").alias("evidence"))


def default_queries(topic: Column, expanded: Column) -> Column:
    """H6."""
    return F.when(F.coalesce(F.size(expanded), F.lit(0)) <= 0, F.array(topic)).otherwise(expanded)


def feasibility_score(difficulty: Column) -> Column:
    """H7."""
    return F.when(difficulty == "low", 0.9).when(difficulty == "medium", 0.6).when(difficulty == "high", 0.3).otherwise(0.5)


def directions(gaps: DataFrame) -> DataFrame:
    """H7: a direction per judged gap."""
    return gaps.select(
        "topic_id",
        F.concat(F.lit("Research Direction: "), F.col("title")).alias("title"),
        F.concat(F.col("description"), F.lit("\n\n"), F.col("recommendation")).alias("description"),
        F.concat(F.lit("Based on gap analysis. Evidence: "), F.col("evidence")).alias("rationale"),
        feasibility_score(F.col("difficulty")).alias("feasibility_score"),
        F.when(F.col("difficulty") != "", F.col("difficulty")).alias("implementation_complexity"),
        "estimated_cost",
        "industry_viability",
        "time_to_mvp",
    )


def _quoted(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def rerank_prompts(topics: DataFrame, ranked: DataFrame, size: int = 10) -> DataFrame:
    """H8: one prompt per batch of papers: 1-based, titles cut at 100 and abstracts at 500 characters, no ids."""
    rows = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int")).withColumn("index", ((F.col("rank") - 1) % size + 1).cast("int"))
    line = F.concat(F.col("index").cast("string"), F.lit(". Title: "), _quoted(truncate_chars(F.col("title"), 100)), F.lit(" Abstract: "), _quoted(truncate_chars(F.coalesce("abstract", F.lit("")), 500)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n")
    per = rows.groupBy("topic_id", "batch").agg(body.alias("body"), F.count("*").alias("n"))
    return per.join(topics, "topic_id").select("topic_id", "batch", F.concat(F.lit("Topic: "), _quoted(F.col("topic")), F.lit("\nScore each of the "), F.col("n").cast("string"), F.lit(" papers from 0 to 1.\n"), F.col("body")).alias("prompt"))


def expansion_prompts(topics: DataFrame) -> DataFrame:
    """H8: one prompt per topic for queries, concepts, subtopics and keywords."""
    shape = '{"expanded_queries": [string], "related_concepts": [string], "subtopics": [string], "search_keywords": [string]}'
    return topics.select("topic_id", F.concat(F.lit("Research topic: "), F.col("topic"), F.lit(f"\nList search queries, related concepts, subtopics and keywords as JSON: {shape}")).alias("prompt"))


def analysis_prompts(texts: DataFrame, most_chars: int = 5000) -> DataFrame:
    """H8: one prompt per paper text, cut to ``most_chars``."""
    shape = '{"problem_statement": string, "methodology": string, "dataset": string, "evaluation_metrics": [string], "key_findings": string, "limitations": string, "future_work": string}'
    return texts.select("paper_id", F.concat(F.lit(f"Describe this paper as JSON only: {shape}\nText: "), truncate_chars(F.coalesce("text", F.lit("")), most_chars)).alias("prompt"))


def gap_prompts(topics: DataFrame, papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """H8: one prompt per topic: ``papers(topic_id, rank, title, limitations)`` by 1-based index, titles cut at 100 and
    limitations at 200 characters, then ``evidence(topic_id, index, text)`` in order. No ids."""
    lines = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    item = F.concat(F.col("rank").cast("string"), F.lit('. {"title": '), _quoted(truncate_chars(F.col("title"), 100)), F.lit(', "limitation": '), _quoted(truncate_chars(F.coalesce("limitations", F.lit("")), 200)), F.lit("}"))
    own = papers.groupBy("topic_id").agg(lines(["rank"], item).alias("_papers"))
    quote = F.concat(F.lit("paper "), F.col("index").cast("string"), F.lit(": "), _quoted(truncate_chars(F.col("text"), 500)))
    found = evidence.groupBy("topic_id").agg(lines(["index", "text"], quote).alias("_evidence"))
    shape = '{"gaps": [{"gap_type": "unexplored|conflicting|limitation", "title": string, "description": string, "evidence_indices": [1], "related_paper_indices": [1]}]}'
    joined = topics.join(own, "topic_id").join(found, "topic_id", "left")
    extra = F.when(F.col("_evidence").isNotNull(), F.concat(F.lit("\nPassages:\n"), F.col("_evidence"))).otherwise("")
    return joined.select("topic_id", F.concat(F.lit("Topic: "), F.col("topic"), F.lit("\nPapers:\n"), F.col("_papers"), extra, F.lit(f"\nName three to five research gaps as JSON only, papers by their number: {shape}")).alias("prompt"))


def feasibility_prompts(gaps: DataFrame) -> DataFrame:
    """H8: one prompt per gap, its evidence cut at 500 characters."""
    shape = '{"difficulty": "low|medium|high", "estimated_cost": string, "industry_viability": string, "time_to_mvp": string, "required_expertise": [string], "potential_challenges": [string], "recommendation": string}'
    return gaps.select("topic_id", "title", F.concat(F.lit("Research gap: "), F.col("title"), F.lit("\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\nEvidence: "), truncate_chars(F.coalesce("evidence", F.lit("")), 500), F.lit(f"\nJudge its feasibility as JSON: {shape}")).alias("prompt"))


def gap_evidence(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """H9: chunks with text, by the index of their paper in the ranked list; other papers are dropped."""
    own = hits.filter("paper_id IS NOT NULL").filter(~_blank(F.col("text")))
    return own.join(ranked.select("topic_id", "paper_id", F.col("rank").alias("index")), ["topic_id", "paper_id"]).select("topic_id", "index", truncate_chars(F.col("text"), 500).alias("text"), "score")
