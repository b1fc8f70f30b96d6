"""Joins, filters, sorts and limits (E1-E17) over tables keyed by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title


def papers_of_topics(papers: DataFrame, memberships: DataFrame) -> DataFrame:
    """Every topic's papers, best first."""
    return memberships.join(papers, "paper_id").orderBy("topic_id", F.desc_nulls_last("score"), "paper_id")


def authors_by_paper(links: DataFrame, authors: DataFrame) -> DataFrame:
    """One ordered array of author names per paper: aggregated once, in place of a sub-query per paper."""
    named = links.join(authors, "author_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "author_id", "name"))), lambda x: x["name"])
    return named.groupBy("paper_id").agg(ordered.alias("authors"))


def with_authors(papers: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """Papers with an analysis, each with an author array, empty where there is none."""
    return papers.filter("analysis IS NOT NULL").join(authors_by_paper(links, authors), "paper_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def authors_of(links: DataFrame, authors: DataFrame, paper_id: Column | int) -> DataFrame:
    """The authors of one paper, in order; the key reaches the scan."""
    return links.filter(F.col("paper_id") == paper_id).join(authors, "author_id").orderBy("position", "author_id")


def in_key_order(rows: DataFrame, *keys: str) -> DataFrame:
    """E4."""
    return rows.orderBy(*keys)


def by_status(rows: DataFrame, *status: str, exclude: bool = False, newest_first: bool = True) -> DataFrame:
    """E5: rows (not) in a status; newest or oldest first."""
    hit = F.col("status").isin(list(status))
    return rows.filter(~hit if exclude else hit).orderBy(F.desc("created_at") if newest_first else F.asc("created_at"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """E6."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def children(rows: DataFrame, parent: str, *order: Column) -> DataFrame:
    """Rows numbered within their parent."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def lookup(rows: DataFrame, **key: object) -> DataFrame:
    """Point lookup by one or more columns."""
    for name, value in key.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def pending(ranked: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work without a finished row, rank order kept."""
    return ranked.join(done.select(*keys), list(keys), "left_anti")


def orphans(papers: DataFrame, memberships: DataFrame) -> DataFrame:
    """Papers that no topic has."""
    return papers.join(memberships.select("paper_id"), "paper_id", "left_anti")


def oldest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n by age."""
    return rows.orderBy(*order).limit(n)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by a map-side maximum."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return best.select("r.*")


def smallest_topic(memberships: DataFrame) -> DataFrame:
    """Each paper's smallest topic; ids compare as text."""
    return memberships.groupBy("paper_id").agg(F.min(F.col("topic_id").cast("string")).alias("topic_id"))


def later_twins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that share their keys with an earlier one: a rank in place of an unequal self-join."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n > 1").drop("_n")


def first_of(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Of several tables in order of priority, the first that has the key."""
    ranked = None
    for priority, rows in enumerate(sources):
        part = rows.select(key, *columns, F.lit(priority).alias("priority"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*columns, "priority"), "priority").alias("r"))
    return best.select(key, "r.*")


def lookup_states(asked: DataFrame, sources: list[DataFrame], columns: list[str], valid: Column) -> DataFrame:
    """E15 for ``asked(topic_id)``: the state by priority of source, and an error for an id that is none or that no source has."""
    found = first_of(sources, "topic_id", columns).withColumn("_hit", F.lit(True))
    error = F.when(~valid, F.concat(F.lit('invalid topic id: "'), "topic_id", F.lit('"'))).when(F.col("_hit").isNull(), F.concat(F.lit("pipeline not found: "), "topic_id"))
    return asked.join(found, "topic_id", "left").select("topic_id", *[F.when(valid, F.col(c)).alias(c) for c in columns], error.alias("error"))


def recovery(live: DataFrame, durable: DataFrame, checkpoints: DataFrame, terminal: list[str]) -> DataFrame:
    """Unfinished topics of both tables, the durable row first, with the stage of their last checkpoint."""
    open_ = lambda df: df.filter(~F.col("status").isin(terminal))
    again = durable.join(open_(live).select("topic_id").distinct(), "topic_id", "left_semi")
    rows = open_(again.unionByName(durable).distinct())
    last = latest(checkpoints, "topic_id", "started_at", "stage").select("topic_id", "stage")
    return rows.join(last, "topic_id", "left").select("topic_id", "status", F.coalesce("stage", F.lit("pending")).alias("stage"))


def term_index(papers: DataFrame) -> DataFrame:
    """(paper_id, term, hits)."""
    terms = F.filter(F.split(normalize_title(F.col("abstract")), " "), lambda t: t != "")
    return papers.select("paper_id", F.explode(terms).alias("term")).groupBy("paper_id", "term").agg(F.count("*").alias("hits"))


def term_match(papers: DataFrame, query: list[str]) -> DataFrame:
    """Papers with every query term, most hits first."""
    own = sorted({t.lower() for t in query})
    found = term_index(papers).filter(F.col("term").isin(own)).groupBy("paper_id").agg(F.count("*").alias("terms"), F.sum("hits").alias("hits"))
    return found.filter(F.col("terms") == len(own)).select("paper_id", "hits").orderBy(F.desc("hits"), "paper_id")
