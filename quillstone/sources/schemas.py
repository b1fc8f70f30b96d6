"""The engine's tables (A12): columns, keys and the rules that check_tables() holds them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import violations

_EMBEDDED = "embedding_provider string, embedding_model string, embedding_dimensions int, instruction_version string, indexing_version string, qdrant_collection string, qdrant_point_id string"

#: The columns of each table.
SCHEMAS = {
    "research_topics": "id string, topic string, expanded_queries string, status string, config string, created_at timestamp, updated_at timestamp, completed_at timestamp, run_id string, current_stage string, progress double, error_message string",
    "authors": "id string, name string, semantic_scholar_id string, orcid string, created_at timestamp",
    "papers": "id string, source string, external_id string, source_url string, title string, abstract string, publication_date date, venue string, pdf_url string, pdf_downloaded boolean, pdf_parsed boolean, created_at timestamp, updated_at timestamp",
    "paper_authors": "paper_id string, author_id string, position int",
    "topic_papers": "topic_id string, paper_id string, discovery_source string, relevance_score double, analysis string, analysis_status string",
    "paper_chunks": f"id string, topic_id string, paper_id string, chunk_type string, chunk_index int, text string, content_hash string, source string, embedding_status string, error_message string, embedded_content_hash string, section_heading string, {_EMBEDDED}",
    "paper_documents": "paper_id string, pdf_hash string, parser_provider string, parser_version string, status string, duration_ms long, warnings string, error_message string, markdown string, parser_json string",
    "embedding_generations": "id string, provider string, model string, dimensions int, instruction_version string, indexing_version string, collection_name string, status string, indexed_chunks long, error_message string, activated_at timestamp",
    "embedding_activation_intents": "id string, generation_id string, target_collection string, alias_name string, previous_collection string, status string, attempts int, last_error string, expected_point_count long, chunk_snapshot_digest string, completed_at timestamp",
    "embedding_cleanup_tasks": "id string, collection_name string, point_id string, topic_id string, paper_id string, chunk_id string, reason string, status string, attempts int, error_message string, completed_at timestamp",
    "research_gaps": "id string, topic_id string, gap_type string, title string, description string, related_paper_ids array<string>, evidence string, feasibility string",
    "novel_directions": "id string, topic_id string, gap_id string, title string, description string, rationale string, feasibility_score double, implementation_complexity string, estimated_cost string, industry_viability string, time_to_mvp string",
    "pipeline_stage_checkpoints": "id string, run_id string, topic_id string, stage string, status string, output string, attempt int, started_at timestamp, completed_at timestamp, error_message string",
}

#: The allowed values of a column.
VALUES = {
    ("research_topics", "status"): ["pending", "processing", "completed", "failed"],
    ("papers", "source"): ["semantic_scholar", "arxiv"],
    ("topic_papers", "analysis_status"): ["pending", "processing", "completed", "failed"],
    ("paper_chunks", "embedding_status"): ["pending", "indexing", "completed", "failed"],
    ("paper_documents", "status"): ["processing", "completed", "failed"],
    ("embedding_generations", "status"): ["building", "ready", "active", "retired", "failed"],
    ("embedding_activation_intents", "status"): ["pending", "alias_switched", "completed", "failed", "superseded"],
    ("research_gaps", "gap_type"): ["unexplored", "conflicting", "limitation"],
    ("novel_directions", "implementation_complexity"): ["low", "medium", "high"],
    ("pipeline_stage_checkpoints", "status"): ["running", "completed", "failed"],
}

#: Unique keys.
KEYS = {
    "research_topics": [["id"], ["run_id"]],
    "authors": [["id"], ["semantic_scholar_id"]],
    "papers": [["id"], ["source", "external_id"]],
    "paper_authors": [["paper_id", "author_id"]],
    "topic_papers": [["topic_id", "paper_id"]],
    "paper_chunks": [["topic_id", "paper_id", "chunk_type", "chunk_index"]],
    "paper_documents": [["paper_id"]],
    "embedding_generations": [["id"], ["collection_name"]],
    "embedding_activation_intents": [["id"], ["generation_id"]],
    "embedding_cleanup_tasks": [["collection_name", "point_id"]],
    "research_gaps": [["id"], ["topic_id", "title"]],
    "novel_directions": [["id"], ["topic_id", "title"]],
    "pipeline_stage_checkpoints": [["run_id", "stage"]],
}

#: Fixed values: (column, table, key) that a table refers to.
REFERENCES = {
    "paper_authors": [("paper_id", "papers", "id"), ("author_id", "authors", "id")],
    "topic_papers": [("topic_id", "research_topics", "id"), ("paper_id", "papers", "id")],
    "paper_chunks": [("topic_id", "research_topics", "id"), ("paper_id", "papers", "id")],
    "paper_documents": [("paper_id", "papers", "id")],
    "embedding_activation_intents": [("generation_id", "embedding_generations", "id")],
    "research_gaps": [("topic_id", "research_topics", "id")],
    "novel_directions": [("topic_id", "research_topics", "id"), ("gap_id", "research_gaps", "id")],
    "embedding_cleanup_tasks": [("topic_id", "research_topics", "id"), ("paper_id", "papers", "id")],
    "pipeline_stage_checkpoints": [("run_id", "research_topics", "run_id"), ("topic_id", "research_topics", "id")],
}

#: Columns that may not be negative, and the one that lies in [0, 1].
NOT_NEGATIVE = {"chunk_index", "duration_ms", "indexed_chunks", "attempts", "position"}
SHARES = {"progress"}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's Parquet folder with its declared columns, so that a scan reads no footers for the schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def check_table(rows: DataFrame, name: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every broken rule of a table: values, ranges, keys, references to those of the ``others`` that are given and, for
    generations, at most one active."""
    rules = {f"{c} value": F.col(c).isin(v) for (t, c), v in VALUES.items() if t == name}
    rules |= {f"{c} negative": F.col(c) >= 0 for c in rows.columns if c in NOT_NEGATIVE}
    rules |= {f"{c} outside 0-1": F.col(c).between(0, 1) for c in rows.columns if c in SHARES}
    key = KEYS[name][0][0]
    out = violations(rows, name, key, rules or {"key": F.col(key).isNotNull()}, {"unique " + ", ".join(k): k for k in KEYS[name]}, {f"{c} not in {t}": (c, others[t], k) for c, t, k in REFERENCES.get(name, []) if t in (others or {})})
    if name == "embedding_generations":
        twice = rows.filter("status = 'active'").agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(twice.select(F.lit(name).alias("table_name"), F.lit("one active").alias("rule"), F.col("n").cast("string").alias("key")))
    return out
