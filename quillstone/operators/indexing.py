"""Vector tables kept up to date as data jobs (G13, G15, D16): only what a plan names is embedded and written.

Tables lie in folders of buckets by paper. A change rewrites the buckets that it touches, by dynamic partition overwrite, so a
job that is repeated after a failure writes the same again and unchanged buckets are never read into a write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, identity_string, point_id
from ..scratch import written
from .vectors import abstract_plan, is_current

CHUNKS = "topic_id string, paper_id long, chunk_type string, chunk_index int, text string, content_hash string, embedding_status string, embedded_content_hash string, embedding_provider string, embedding_model string, embedding_dimensions int, instruction_version string, indexing_version string, qdrant_collection string, qdrant_point_id string, error_message string"
POINTS = "point_id string, topic_id string, paper_id long, chunk_type string, chunk_index int, content_hash string, collection_name string, embedding array<double>"
CLEANUP = "collection_name string, point_id string, topic_id string, paper_id long, reason string, status string"
TABLES = {"chunks": (CHUNKS, ["topic_id", "paper_id", "chunk_type", "chunk_index"]), "points": (POINTS, ["point_id"]), "cleanup": (CLEANUP, ["collection_name", "point_id"])}

#: From a text column to a vector column; null where a text could not be embedded.
Embedder = Callable[[Column], Column]


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables of an index."""
    for name, (schema, _) in TABLES.items():
        spark.createDataFrame([], f"{schema}, bucket int").write.partitionBy("bucket").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name][0]}, bucket int").parquet(f"{root}/{name}")


def replace_rows(spark: SparkSession, root: str, name: str, rows: DataFrame, buckets: int) -> None:
    """Rows of a table by its key, in the buckets (by paper) that have any; the table's other rows there are kept."""
    schema, keys = TABLES[name]
    new = rows.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    touched = new.select("bucket").distinct()
    old = read_table(spark, root, name).join(touched.hint("broadcast"), "bucket", "left_semi")  # at most ``buckets`` rows
    kept = old.join(new.select(*keys).hint("merge"), keys, "left_anti")
    columns = [c.split()[0] for c in schema.split(", ")]
    _put(kept.select(*columns, "bucket").unionByName(new.select(*columns, "bucket")), f"{root}/{name}", f"{name}-buckets")


def _put(rows: DataFrame, path: str, tag: str) -> None:
    """Whole buckets in place of those of a table that ``rows`` are read from. They are staged by bucket, so each task writes
    the buckets it has and no row is dealt to its bucket's one task."""
    staged = written(rows, tag, by="bucket", compression="zstd")
    staged.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _identity(identity: dict[str, object]) -> Column:
    return identity_string(*[F.lit(identity[k]) for k in ("provider", "model", "dimensions", "instruction_version", "indexing_version")])


def ensure_abstract_index(papers: DataFrame, root: str, identity: dict[str, object], collection: str, embedder: Embedder, buckets: int = 64) -> dict[str, int]:
    """Every abstract of ``papers(topic_id, paper_id, abstract)`` has a current chunk and its point; how many needed what.

    New, changed and stale abstracts and those whose point is lost are embedded, no others. A replaced point goes to the
    clean-up table. Chunks are ``indexing`` with the identity and the id of their point before the points are written and
    ``completed`` after it, so a run that broke off is made good by the next one. Nothing to do: nothing is written.
    """
    spark = papers.sparkSession
    chunks, points = read_table(spark, root, "chunks"), read_table(spark, root, "points")
    plan = written(abstract_plan(papers, chunks, points.select("point_id"), is_current(identity, collection)).filter("action != 'ok'"), "index-plan")
    todo = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if not todo:
        return {}
    texts = papers.join(plan.select("topic_id", "paper_id").hint("merge"), ["topic_id", "paper_id"], "left_semi").select("topic_id", "paper_id", F.col("abstract").alias("text"))
    hashed = texts.withColumn("content_hash", content_hash(F.col("text")))
    place = point_id(F.col("topic_id"), F.col("paper_id"), F.lit("abstract"), F.lit(0), F.col("content_hash"), _identity(identity))
    made = written(hashed.withColumns({"point_id": place, "embedding": embedder(F.col("text"))}), "embedded", compression="zstd")
    failed = made.filter("embedding IS NULL").limit(1).count()
    if failed:
        raise ValueError("abstracts could not be embedded; nothing was written")
    row = made.select(
        "topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), "text", "content_hash",
        F.lit("indexing").alias("embedding_status"), F.lit(None).cast("string").alias("embedded_content_hash"),
        F.lit(identity["provider"]).alias("embedding_provider"), F.lit(identity["model"]).alias("embedding_model"), F.lit(identity["dimensions"]).cast("int").alias("embedding_dimensions"),
        F.lit(identity["instruction_version"]).alias("instruction_version"), F.lit(identity["indexing_version"]).alias("indexing_version"),
        F.lit(collection).alias("qdrant_collection"), F.col("point_id").alias("qdrant_point_id"), F.lit(None).cast("string").alias("error_message"),
    )
    gone = plan.filter("cleanup_point IS NOT NULL").join(chunks.select("topic_id", "paper_id", "qdrant_collection").hint("merge"), ["topic_id", "paper_id"])
    tasks = gone.select(F.col("qdrant_collection").alias("collection_name"), F.col("cleanup_point").alias("point_id"), "topic_id", "paper_id", F.lit("abstract content replaced").alias("reason"), F.lit("pending").alias("status"))
    if todo.get("changed"):
        replace_rows(spark, root, "cleanup", written(tasks, "cleanup-tasks"), buckets)
    replace_rows(spark, root, "chunks", row, buckets)
    replace_rows(spark, root, "points", made.select("point_id", "topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), "content_hash", F.lit(collection).alias("collection_name"), "embedding"), buckets)
    replace_rows(spark, root, "chunks", row.withColumns({"embedding_status": F.lit("completed"), "embedded_content_hash": F.col("content_hash")}), buckets)
    return todo


def run_pending_cleanup(spark: SparkSession, root: str, buckets: int = 64) -> int:
    """G20 on the written tables: points of pending tasks are deleted and the tasks completed; how many."""
    pending = written(read_table(spark, root, "cleanup").filter("status = 'pending'"), "pending-tasks")
    n = pending.count()
    if n:
        touched = pending.select("bucket").distinct()
        old = read_table(spark, root, "points").join(touched.hint("broadcast"), "bucket", "left_semi")
        _put(old.join(pending.select("point_id").hint("merge"), "point_id", "left_anti").select(*old.columns), f"{root}/points", "points-buckets")
        replace_rows(spark, root, "cleanup", pending.withColumn("status", F.lit("completed")).drop("bucket"), buckets)
    return n


def build_generation(chunks: DataFrame, root: str, generation: str, identity: dict[str, object], collection: str, embedder: Embedder) -> DataFrame:
    """The points of all ``chunks(topic_id, paper_id, chunk_type, chunk_index, text, content_hash)`` under
    ``root``/points/gen=<generation>, and the generation's row, which is also written.

    Both counts are observed by the job that writes the points. The row is written after it: ``ready`` only if every chunk has
    its point of the right dimension, else ``failed`` with the reason. A repeated build overwrites its own folders.
    """
    spark = chunks.sparkSession
    wanted, stored = Observation(), Observation()
    place = point_id(F.col("topic_id"), F.col("paper_id"), F.col("chunk_type"), F.col("chunk_index"), F.col("content_hash"), _identity(identity))
    # observed after the embedding: a filter is not pushed below an observation, and would embed every text a second time there
    made = chunks.withColumns({"point_id": place, "collection_name": F.lit(collection), "embedding": embedder(F.col("text"))}).observe(wanted, F.count(F.lit(1)).alias("n"))
    columns = [c.split()[0] for c in POINTS.split(", ")]
    points = made.filter(F.size("embedding") == F.lit(identity["dimensions"])).select(*columns).observe(stored, F.count(F.lit(1)).alias("n"))
    points.write.mode("overwrite").parquet(f"{root}/points/gen={generation}")
    n, want = stored.get["n"], wanted.get["n"]
    error = "no durable chunks are available to reindex" if not want else None if n == want else f"rebuilt collection contains {n} points; expected {want}; activation refused"
    row = spark.createDataFrame([(generation, collection, want, n, "failed" if error else "ready", error)], "generation string, collection_name string, chunks long, indexed_chunks long, status string, error_message string")
    row.write.mode("overwrite").parquet(f"{root}/generations/gen={generation}")
    return spark.read.schema(row.schema).parquet(f"{root}/generations/gen={generation}")

