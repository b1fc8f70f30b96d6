"""Operator 8: drop lines that stand on too large a share of a site's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RATIO, LEAST_PAGES = 0.1, 5
#: At most this many boilerplate lines are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``(host, drop array<long>)``: hashes of the lines on more than ``ratio`` of the host's pages and ``least_pages`` at least.

    Lines travel as 64-bit hashes and are counted in the map tasks first. A host has at most (mean distinct lines of a
    page) / ratio such lines, so its array stays short however many pages it has. With
    ``copies_once``, pages of a host with the same text (by hash) are one page in both counts.
    """
    pages = docs.filter(F.col(host).isNotNull()).select(F.col(host).cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    if copies_once:
        pages = pages.withColumn("page", F.xxhash64("text"))
    totals = (pages.select("host", "page").distinct() if copies_once else pages).groupBy("host").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(_trimmed(x))))
    # explode_outer: with explode, Spark would filter on the size of the array and so compute the array twice
    lines = pages.select("host", *(["page"] if copies_once else []), F.explode_outer(own).alias("line")).filter("line IS NOT NULL")
    counts = (lines.distinct() if copies_once else lines).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    joined = counts.join(totals.hint("merge"), "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return joined.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs(text, <host>, …)`` with two columns more, ``n_lines`` and ``n_dropped``, and the text without such lines.

    Lines are parted by line feeds and compared without white space at their ends; blank lines are never counted or
    dropped. A page counts once for a line however often it has it. Rows with a null host keep their text; null texts
    stay null with 0 lines. Repeated rows count as pages of their own, unless ``copies_once``: then exact copies
    on a host count as one page, so that no text is dropped for being copied. An empty table gives no rows; other columns pass
    through.
    """
    found = written(boilerplate(docs, host, ratio, least_pages, copies_once), "boilerplate")
    size = found.agg(F.sum(F.size("drop"))).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).cast("string").alias("host"), F.col("text").alias("own_text"))
    joined = rows.join(found.hint("broadcast" if size <= BROADCAST_LINES else "merge"), "host", "left")
    lines = _lines(F.coalesce("own_text", F.lit("")))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("drop", F.xxhash64(_trimmed(x))))))
    cut = joined.withColumn("kept", kept).withColumn("n_lines", F.when(F.col("own_text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    cut = cut.withColumn("n_dropped", F.when(F.col("own_text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    text = F.when(F.col("n_dropped") == 0, F.col("own_text")).otherwise(F.array_join("kept", "\n"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op8_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of documents, with n_chars of the text that is left.

    Near-dedup comes later, so copies of one text count as one page here. Else as ``drop_boilerplate``; columns of the
    documents that are named like its counts keep their values.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    cut = drop_boilerplate(docs.withColumnsRenamed(own), copies_once=True)
    cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP8_SQL = f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(line, {_WS}) AS key FROM l),
c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' AND source IS NOT NULL GROUP BY source, key),
t AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT c.source, c.key FROM c JOIN t USING (source) WHERE n >= {LEAST_PAGES} AND n > {RATIO}::DOUBLE * pages),
m AS (SELECT k.*, b.key IS NOT NULL AS dropped FROM k LEFT JOIN b ON k.source = b.source AND k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
FROM m GROUP BY doc_id
"""
