"""Operator 5: benchmark items inside long documents, by size-partitioned MinHash containment search.

A short item and a long document have next to no Jaccard similarity, so banded signatures of whole documents miss them.
Here each size of item (its number of distinct shingles q) is a partition of its own with its own signature length: the
``q - ceil(threshold * q) + 1`` smallest hashes of its shingles. A document that contains at least ``threshold`` of the
shingles must contain one of these, so looking the document's shingle hashes up among the signatures finds every match.
Candidates are then verified by comparing the shingles themselves. Items of fewer words than a shingle are a partition for
each number of words: their one shingle is the whole item, and it is looked up in the documents' windows of that width.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SHINGLE, THRESHOLD = 5, 0.8
#: Signatures up to this many rows (16 bytes each) and items up to this many shingles are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
#: Up to this many texts' hashes are sent to all tasks to filter documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _positions(words: str, width: int) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def _hashes(words: str, width: int) -> Column:
    return F.transform(_positions(words, width), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))


def _windows(words: str, width: int) -> Column:
    return F.transform(_positions(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def signatures(items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(item rows with their shingles and the count a match needs, (hash, item_id) signature rows)."""
    made = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words"))
    made = made.withColumn("shingles", F.array_distinct(_windows("words", width)))
    made = made.withColumn("hashes", F.array_distinct(_hashes("words", width)))
    made = made.select("item_id", "shingles", "hashes", F.ceil(F.lit(threshold) * F.size("shingles") - 1e-9).cast("int").alias("need"))
    made = written(made, "benchmark-items").filter(F.size("shingles") > 0)
    length = F.size("hashes") - F.col("need") + 1
    return made, made.select("item_id", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), F.greatest(length, F.lit(1)))).alias("h"))


def _verified(candidates: DataFrame, width: int) -> DataFrame:
    """Exact containment of rows with words, hashes and an item's shingles, hashes and need."""
    at = F.filter(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.array_contains("item_hashes", F.get(F.col("hashes"), i)))
    seen = F.array_intersect("shingles", F.transform(at, lambda i: F.array_join(F.slice("words", i + 1, width), " ")))
    near = candidates.filter(F.size(F.array_intersect("item_hashes", "hashes")) >= F.col("need"))
    found = near.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(seen).cast("long").alias("n_found"), "need")
    found = found.filter(F.col("n_found") >= F.col("need")).groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return found.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` of every item of which a document has ``threshold`` or more.

    Words are lower-case runs of letters and digits, shingles are ``width`` words. An item of fewer words is one shingle, the
    whole of it, which a document contains as a window of that many words. Null and empty texts match nothing, and neither
    do items without a word. Repeated rows with one id give one row with
    the larger count. Null ids are reported as null doc_ids; items without an id are left out. Empty tables give no rows;
    other columns are ignored.
    """
    short = short_items(docs, items, width, broadcast_rows)
    return _long_items(docs, items, threshold, width, broadcast_rows).unionByName(short)


def short_items(docs: DataFrame, items: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """Rows of ``contained_items`` for items of 1 to ``width`` - 1 words. Only windows as wide as some such item are made."""
    made = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words"))
    made = made.filter(F.size("words").between(1, width - 1)).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("s")).distinct()
    made = written(made, "short-items")
    counts = {r["n"]: r["items"] for r in made.groupBy("n").agg(F.count("*").alias("items")).collect()}
    hint = "broadcast" if sum(counts.values()) <= broadcast_rows else "merge"
    own = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    windows = [_windows("words", n) for n in sorted(counts)]
    own = own.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*windows)) if windows else F.array().cast("array<string>")).alias("s"))
    found = own.join(made.hint(hint), "s").select("doc_id", "item_id").distinct() if windows else docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    one = F.lit(1).cast("long")
    return found.select("doc_id", "item_id", one.alias("n_shingles"), one.alias("n_found"), F.lit(1.0).alias("containment"))


def _long_items(docs: DataFrame, items: DataFrame, threshold: float, width: int, broadcast_rows: int) -> DataFrame:
    """Rows of ``contained_items`` for items of ``width`` words or more."""
    made, signature = signatures(items, threshold, width)
    size = made.agg(F.sum(F.size("hashes")).alias("n")).first()["n"] or 0
    own = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words")).withColumn("hashes", _hashes("words", width))
    item = made.select("item_id", "shingles", F.col("hashes").alias("item_hashes"), "need")
    # explode_outer: with explode, Spark would filter on the size of the array and so compute the array twice
    if size <= broadcast_rows:
        hits = own.select("doc_id", "words", "hashes", F.explode_outer("hashes").alias("h")).join(signature.hint("broadcast"), "h")
        return _verified(hits.drop("h").join(item.hint("broadcast"), "item_id"), width)
    keyed = own.select("doc_id", F.explode_outer(F.array_distinct("hashes")).alias("h")).join(signature.hint("merge"), "h").select("doc_id", "item_id").distinct()
    pairs = keyed.join(item.hint("merge"), "item_id").withColumnRenamed("doc_id", "_id")
    return _verified(own.join(pairs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id"), width)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose text contains no benchmark item by ``contained_items``.

    Rows go by their text (as a 64-bit hash), not by their id: rows with a null id or an id that others share are judged
    like any other, and equal texts alike. Null and empty texts stay. An empty table gives no rows; other columns, whatever
    their names, pass through.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = written(contained_items(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    small = found.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    kept = rows.join(found.hint("broadcast" if small else "merge"), "_key", "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _sql_shingles(source: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM (SELECT {key}, {_SQL_WORDS} AS w FROM {source}) WHERE len(w) >= {SHINGLE}"


OP5_SQL = f"""
WITH i AS ({_sql_shingles("benchmark", "item_id")}), q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS ({_sql_shingles("documents", "doc_id")}),
m AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, k AS n_found, round(k::DOUBLE / n, 6) AS containment
FROM m JOIN q USING (item_id) WHERE k >= ceil({THRESHOLD}::DOUBLE * n - 1e-9)
UNION ALL
SELECT DISTINCT doc_id, item_id, 1, 1, 1.0::DOUBLE
FROM (SELECT doc_id, ' ' || array_to_string({_SQL_WORDS}, ' ') || ' ' AS t FROM documents)
JOIN (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) ON len(w) BETWEEN 1 AND {SHINGLE - 1} AND contains(t, ' ' || array_to_string(w, ' ') || ' ')
"""
