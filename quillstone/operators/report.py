"""Report assembly (R1-R8): Markdown, tables and bibliographies for every topic in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bibtex_type, empty_if_null, format_evidence, sanitize_bibtex
from .judged import ANALYSIS


def paper_summaries(papers: DataFrame) -> DataFrame:
    """``(topic_id, paper_id, title, authors, abstract, venue, year, score, analysis json)`` with blanks for what is missing."""
    a = F.from_json("analysis", ANALYSIS)
    parts = [F.coalesce(a[c], F.lit("")).alias(c) for c in ("problem_statement", "methodology", "key_findings", "limitations")]
    return papers.select("topic_id", "paper_id", "title", "authors", empty_if_null(F.col("abstract")).alias("abstract"), empty_if_null(F.col("venue")).alias("venue"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("score", F.lit(0.0)).alias("score"), *parts)


def gap_summaries(gaps: DataFrame) -> DataFrame:
    """R2."""
    return gaps.select("topic_id", "ordinal", "gap_type", "title", *[empty_if_null(F.col(c)).alias(c) for c in ("description", "evidence")])


def direction_summaries(directions: DataFrame) -> DataFrame:
    """R2."""
    text = ["description", "difficulty", "estimated_cost", "industry_viability", "time_to_mvp"]
    return directions.select("topic_id", "ordinal", "title", *[empty_if_null(F.col(c)).alias(c) for c in text], F.coalesce("score", F.lit(0.0)).alias("score"))


def joined_lines(order: str | list[str], line: Column, sep: str = "") -> Column:
    """Lines of a group in order."""
    keys = [order] if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, line.alias("_line")))), lambda x: x["_line"]), sep)


def per_topic(topics: DataFrame, papers: DataFrame, gaps: DataFrame, directions: DataFrame) -> DataFrame:
    """All text parts of a topic's report, from one aggregation per table. Papers are taken by descending score."""
    bullet = F.concat(F.lit("- **"), F.col("title"), F.lit("** ("), F.col("gap_type"), F.lit("): "), F.col("description"), F.lit("\n"))
    section = F.concat(F.lit(". "), F.col("title"), F.lit("\n\n**Type:** "), F.col("gap_type"), F.lit("\n\n**Description:** "), F.col("description"), F.lit("\n\n**Evidence:** "), format_evidence(F.col("evidence")), F.lit("\n\n"))
    numbered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c.alias("s")))), lambda x, i: F.concat(F.lit("## "), (i + 1).cast("string"), x["s"])), "")
    g = gap_summaries(gaps).groupBy("topic_id").agg(F.count("*").alias("n_gaps"), joined_lines("ordinal", bullet).alias("gap_bullets"), numbered(section).alias("gap_sections"))
    d_bullet = F.format_string("- **%s** (Difficulty: %s, Score: %.1f)\n", "title", "difficulty", "score")
    d_section = F.concat(F.lit(". "), F.col("title"), F.lit("\n\n**Difficulty:** "), F.col("difficulty"), F.lit("\n**Estimated Cost:** "), F.col("estimated_cost"), F.lit("\n**Industry Viability:** "), F.col("industry_viability"), F.lit("\n**Time to MVP:** "), F.col("time_to_mvp"), F.lit("\n**Description:** "), F.col("description"), F.lit("\n\n"))
    d = direction_summaries(directions).groupBy("topic_id").agg(F.count("*").alias("n_directions"), joined_lines("ordinal", d_bullet).alias("direction_bullets"), numbered(d_section).alias("direction_sections"))
    rows = paper_summaries(papers).withColumn("_by", -F.col("score"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "title", "methodology", "key_findings", "limitations"), F.lit(" |\n"))
    p = rows.groupBy("topic_id").agg(F.count("*").alias("n_papers"), joined_lines(["_by", "paper_id"], cells).alias("rows"), joined_lines(["_by", "paper_id"], bibtex_entry(), "\n").alias("bibtex"))
    zero = {"n_papers": 0, "n_gaps": 0, "n_directions": 0, "rows": "", "bibtex": "", "gap_bullets": "", "gap_sections": "", "direction_bullets": "", "direction_sections": ""}
    return topics.join(p, "topic_id", "left").join(g, "topic_id", "left").join(d, "topic_id", "left").fillna(zero)


def executive_summary(day: Column) -> Column:
    """R3, over per_topic() rows."""
    gaps = F.when(F.col("n_gaps") > 0, F.concat(F.format_string("### Research Gaps Identified: %d\n\n", "n_gaps"), F.col("gap_bullets"), F.lit("\n"))).otherwise("")
    dirs = F.when(F.col("n_directions") > 0, F.concat(F.format_string("### Research Directions Proposed: %d\n\n", "n_directions"), F.col("direction_bullets"), F.lit("\n"))).otherwise("")
    head = F.format_string("# Executive Summary\n\nThis report analyzes **%d** academic papers related to: **%s**\n\n", "n_papers", "topic")
    return F.concat(head, gaps, dirs, F.lit("*Report generated on "), F.date_format(day, "MMMM d, yyyy"), F.lit("*\n"))


def literature_table() -> Column:
    """R4, over per_topic() rows."""
    head = F.format_string("# Literature Review\n\nTotal papers analyzed: %d\n\n## Comparative Table\n\n", "n_papers")
    return F.concat(head, F.lit("| Title | Methodology | Key Findings | Limitations |\n|-------|-------------|--------------|-------------|\n"), F.col("rows"))


def _field(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), sanitize_bibtex(value), F.lit("},\n"))).otherwise("")


def bibtex_entry(full: bool = False) -> Column:
    """An entry over (paper_id, authors, title, year, venue, abstract) and, if full, publisher, doi, url, arxiv_id."""
    arxiv = F.col("arxiv_id") if full else F.lit("")
    kind = bibtex_type(arxiv, F.col("venue"))
    year = F.when(F.col("year") > 0, F.format_string("  year = {%d},\n", "year")).otherwise("")
    venue = F.when(kind == "inproceedings", _field("booktitle", F.col("venue"))).otherwise(_field("journal", F.col("venue")))
    more = [_field("publisher", F.col("publisher")), _field("doi", F.col("doi")), _field("url", F.col("url")), F.when(F.coalesce(arxiv, F.lit("")) != "", F.concat(_field("eprint", arxiv), F.lit("  archiveprefix = {arXiv},\n"))).otherwise("")] if full else []
    return F.concat(F.lit("@"), kind, F.lit("{"), F.col("paper_id").cast("string"), F.lit(",\n"), _field("author", F.array_join("authors", " and ")), _field("title", F.col("title")), year, venue, *more, _field("abstract", F.col("abstract")), F.lit("}\n"))


def report_markdown(summary: Column, table: Column) -> Column:
    """R6, over per_topic() rows."""
    rule = F.lit("\n\n---\n\n")
    gaps = F.when(F.col("n_gaps") > 0, F.concat(rule, F.lit("# Research Gaps\n\n"), F.col("gap_sections"))).otherwise("")
    dirs = F.when(F.col("n_directions") > 0, F.concat(rule, F.lit("# Proposed Research Directions\n\n"), F.col("direction_sections"))).otherwise("")
    return F.concat(summary, rule, table, gaps, dirs, rule, F.lit("# References\n\n```bibtex\n"), F.col("bibtex"), F.lit("\n```\n"))


def assemble_report(topics: DataFrame, papers: DataFrame, gaps: DataFrame, directions: DataFrame, day: Column) -> DataFrame:
    """One row per topic with every part."""
    rows = per_topic(topics, papers, gaps, directions)
    out = rows.withColumn("executive_summary", executive_summary(day)).withColumn("literature_review", literature_table())
    return out.withColumn("markdown", report_markdown(F.col("executive_summary"), F.col("literature_review"))).select("topic_id", "topic", "n_papers", "n_gaps", "n_directions", "executive_summary", "literature_review", "bibtex", "markdown")


def citation_faults(gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """Evidence keys without a bibliography entry in their topic."""
    keys = gaps.select("topic_id", "title", F.explode(F.filter(F.transform(F.split(empty_if_null(F.col("evidence")), ","), lambda k: F.trim(k)), lambda k: k != "")).alias("key"))
    return keys.join(papers.select("topic_id", F.col("paper_id").cast("string").alias("key")), ["topic_id", "key"], "left_anti")
