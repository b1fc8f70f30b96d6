"""Vectors (G1-G21): exact filtered search, ranking, and versioned vector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import content_hash, point_id
from .aggregates import best_score

IDENTITY = ["provider", "model", "dimensions", "instruction_version", "indexing_version"]
#: Queries up to this many bytes of vectors are sent to the vectors; more are dealt by topic.
BROADCAST_BYTES = 64 << 20


def vector_faults(rows: DataFrame, key: str, dimension: int) -> DataFrame:
    """G1: (key, fault) of vectors that are empty, of another dimension, or not finite."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fault = F.when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "empty").when(F.size("embedding") != dimension, "dimension").when(bad, "not finite")
    return rows.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def query_text(instruction: Column, query: Column) -> Column:
    """G2."""
    return F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery:"), query)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_embedding(text: Column, dimension: int) -> Column:
    """G3's default: term frequencies hashed to ``dimension`` bins, normalised to length one; without words zeros.

    The bins are sorted once, the ends of their runs give the counts, and zeros fill the gaps between them: the work is that of
    sorting the words plus the dimension.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    bins = F.sort_array(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    empty = F.array().cast("array<int>")
    ends_of = lambda own: F.when(F.size(own) > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size(own), F.lit(1)) - 1), lambda i: ~F.get(own, i).eqNullSafe(F.get(own, i + 1)))).otherwise(empty)

    def dense(own: Column, ends: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(ends, k - 1)).otherwise(-1)
        last_bin = lambda k: F.when(k > 0, F.get(own, before(k))).otherwise(-1)
        runs = F.flatten(F.transform(ends, lambda e, k: F.concat(zeros(F.get(own, e) - last_bin(k) - 1), F.array((e - before(k)).cast("double")))))
        return F.concat(runs, zeros(F.lit(dimension - 1) - F.coalesce(F.get(own, F.size(own) - 1), F.lit(-1))))

    return _let(_let(bins, lambda own: _let(ends_of(own), lambda ends: dense(own, ends))), unit)


def model_embedding(make: Callable[[], Callable], batch_size: int = 32) -> Callable[[Column], Column]:
    """A model as an embedder: ``make`` runs once in each worker and returns a function from a numpy array of texts to the
    matrix of their vectors."""
    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)


def embed(rows: DataFrame, text: str, dimension: int, fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """``fn`` maps a text column to a vector column, for instance ``model_embedding``."""
    return rows.withColumn("embedding", (fn or (lambda c: hashed_embedding(c, dimension)))(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Normalised; a zero vector stays zero."""
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]


def top_k(queries: DataFrame, vectors: DataFrame, k: int | None, by: list[str] | None = None, chunk_types: tuple[str, ...] | None = None) -> DataFrame:
    """The k best of each query (all if None) by exact cosine within the columns ``by`` (the topic).

    Vectors are normalised once and stream past a checked, broadcast set of queries; each task keeps k rows per query
    before the shuffle (Spark's window group limit). Scores are ranked as they are, not rounded; ties go to the smaller point.
    """
    by = by or ["topic_id"]
    own = vectors if chunk_types is None else vectors.filter(F.col("chunk_type").isin(list(chunk_types)))
    own = own.withColumn("_v", unit(F.col("embedding"))).drop("embedding")
    asked = queries.select("query_id", *by, unit(F.col("embedding")).alias("_q"))
    size = asked.agg(F.sum(8 * F.size("_q") + 64)).first()[0] or 0
    hits = own.join(asked.hint("broadcast" if size <= BROADCAST_BYTES else "merge"), by).withColumn("score", dot(F.col("_v"), F.col("_q"))).drop("_v", "_q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def search_chunks(queries: DataFrame, vectors: DataFrame, k: int = 12) -> DataFrame:
    """PDF chunks only."""
    return top_k(queries, vectors, k, chunk_types=("pdf",))


def rank_limit(n: Column, most: int) -> Column:
    """G6."""
    return F.greatest(F.lit(1), F.least(n, F.lit(most)) if most > 0 else n)


def rank_papers(queries: DataFrame, vectors: DataFrame, per_topic: int, chunk_types: tuple[str, ...] | None = None) -> DataFrame:
    """Search, best chunk per paper, cap by the topic's number of papers. ``per_topic`` of 0 or less sets no limit."""
    hits = top_k(queries, vectors, per_topic if per_topic > 0 else None, chunk_types=chunk_types)
    n = vectors.groupBy("topic_id").agg(F.count_distinct("paper_id").alias("_n"))
    ranked = best_score(hits).join(n, "topic_id")
    return ranked.filter(F.col("rank") <= rank_limit(F.col("_n"), per_topic)).drop("_n")


def blend(ranked: DataFrame, judged: DataFrame, size: int = 10, vector: float = 0.3, judge: float = 0.7) -> DataFrame:
    """Scores of valid batches are blended; an invalid batch keeps its vector scores; then ranked anew.

    ``ranked(topic_id, paper_id, score, rank)``; ``judged(topic_id, batch, index, judge)`` with 1-based indices. A batch is
    valid if it has each index once, in range, with a finite score in [0, 1].
    """
    rows = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int")).withColumn("index", ((F.col("rank") - 1) % size + 1).cast("int"))
    sizes = rows.groupBy("topic_id", "batch").agg(F.count("*").alias("_n"))
    fine = F.col("judge").isNotNull() & ~F.isnan("judge") & F.col("judge").between(0, 1)
    in_range = fine & F.col("index").between(1, F.col("_n"))
    check = judged.join(sizes, ["topic_id", "batch"]).groupBy("topic_id", "batch").agg(((F.count("*") == F.first("_n")) & (F.count_distinct("index") == F.first("_n")) & F.bool_and(in_range)).alias("_ok"))
    good = judged.join(check.filter("_ok"), ["topic_id", "batch"], "left_semi")
    j = rows.join(good, ["topic_id", "batch", "index"], "left")
    mixed = F.when(F.col("judge").isNotNull(), F.lit(vector) * F.col("score") + F.lit(judge) * F.col("judge")).otherwise(F.col("score"))
    out = j.select("topic_id", "paper_id", mixed.alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "paper_id")))


def upsert_points(old: DataFrame, new: DataFrame, identity: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(points, faults). ``new`` has ``topic_id, paper_id, chunk_type, chunk_index, text, content_hash, embedding`` and the
    columns of the identity.

    An identity without any value is taken as the expected one and a missing hash is that of the text; the point's id follows
    from both. Points replace those of the same id. A row of another identity or with a bad vector is not stored but
    reported with its reason.
    """
    unset = F.lit(True)
    for name in identity:
        unset = unset & F.col(name).isNull()
    own = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in identity])
    want = ":".join(str(v) for v in identity.values())
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    size = F.coalesce(F.size("embedding"), F.lit(0))
    where = F.concat(F.lit("validate vector for paper "), F.col("paper_id").cast("string"), F.lit(" chunk "), F.col("chunk_index").cast("string"), F.lit(": "))
    fault = F.when(~unset & (own != want), F.concat(F.lit("embedding identity mismatch: got "), own, F.lit(f" want {want}")))
    fault = fault.when(size <= 0, F.concat(where, F.lit("empty"))).when(size != identity["dimensions"], F.concat(where, F.lit("dimension"))).when(bad, F.concat(where, F.lit("not finite")))
    filled = new.withColumn("content_hash", F.when(F.coalesce("content_hash", F.lit("")) == "", content_hash(F.col("text"))).otherwise(F.col("content_hash"))).withColumn("_fault", fault)
    place = point_id(F.col("topic_id"), F.col("paper_id"), F.col("chunk_type"), F.col("chunk_index"), F.col("content_hash"), F.lit(want))
    good = filled.filter("_fault IS NULL").withColumn("point_id", place)
    points = old.join(good.select("point_id").hint("merge"), "point_id", "left_anti").unionByName(good.select(*old.columns))
    return points, filled.filter("_fault IS NOT NULL").select("topic_id", "paper_id", "chunk_index", F.col("_fault").alias("fault"))


def delete_points(points: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Without these ids, or without the rows that match a payload filter."""
    out = points if ids is None else points.join(ids.select("point_id"), "point_id", "left_anti")
    return out if where is None else out.filter(~F.coalesce(where, F.lit(False)))


def existing_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Which of the ids are there; the vectors are not read."""
    return ids.select("point_id").join(points.select("point_id"), "point_id", "left_semi")


def scroll(points: DataFrame, where: Column, limit: int) -> DataFrame:
    """The first points by id that match."""
    return points.filter(where).orderBy("point_id").limit(limit)


def point_ids(points: DataFrame) -> DataFrame:
    """All ids of a generation; neither payload nor vectors are read."""
    return points.select("point_id")


def is_current(identity: dict[str, object], collection: str) -> Column:
    """Embedded as it is now, under this identity and collection."""
    names = {"provider": "embedding_provider", "model": "embedding_model", "dimensions": "embedding_dimensions"}
    same = [F.col(names.get(k, k)).eqNullSafe(F.lit(v)) for k, v in identity.items()]
    out = F.col("embedding_status").eqNullSafe("completed") & F.col("embedded_content_hash").eqNullSafe(F.col("content_hash")) & F.col("qdrant_collection").eqNullSafe(collection) & F.col("qdrant_point_id").isNotNull()
    for s in same:
        out = out & s
    return out


def abstract_plan(papers: DataFrame, chunks: DataFrame, points: DataFrame, current: Column) -> DataFrame:
    """Per paper with an abstract what its index needs: ``new``, ``changed``, ``stale``, ``missing`` or ``ok``.

    New and changed abstracts are embedded, a changed one's old point goes to clean-up; a chunk that is not current or whose
    point is lost is embedded again.
    """
    rows = papers.filter(F.trim(F.coalesce("abstract", F.lit(""))) != "").select("topic_id", "paper_id", F.sha2("abstract", 256).alias("_h"))
    own = chunks.filter("chunk_type = 'abstract' AND chunk_index = 0").select("topic_id", "paper_id", F.col("content_hash").alias("_o"), current.alias("_c"), F.col("qdrant_point_id").alias("point_id"))
    there = points.select("point_id", F.lit(True).alias("_there"))
    j = rows.join(own, ["topic_id", "paper_id"], "left").join(there, "point_id", "left")
    action = F.when(F.col("_o").isNull(), "new").when(F.col("_o") != F.col("_h"), "changed").when(~F.col("_c"), "stale").when(F.col("_there").isNull(), "missing").otherwise("ok")
    return j.select("topic_id", "paper_id", action.alias("action"), F.when(action == "changed", F.col("point_id")).alias("cleanup_point"))


def collection_check(points: DataFrame, dimension: int, expected: int) -> DataFrame:
    """G14."""
    out = points.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    return out.withColumn("ok", (F.col("n") == expected) & (F.col("low") == dimension) & (F.col("high") == dimension))


def snapshot_digest(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """One digest over all chunks, whatever their order.

    Row hashes are joined per hash prefix and then over the 65,536 prefixes, so no task gets all rows. The value differs
    from a sequential hash of the same rows, but changes whenever one of them does.
    """
    row = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    part = chunks.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], x["d"])), ""), 256).alias("digest"))


def activate(pointer: Column, previous: Column, target: Column) -> Column:
    """The pointer after a compare-and-swap: already there is fine, anything but ``previous`` is a conflict (null)."""
    return F.when(pointer.eqNullSafe(target), target).when(pointer.eqNullSafe(previous), target)


def finalize(generations: DataFrame, target: str, digest: Column, expected_digest: Column) -> DataFrame:
    """The target becomes active and the other active one retires, if the snapshot is unchanged."""
    same = digest == expected_digest
    status = F.when(same & (F.col("id") == target), "active").when(same & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return generations.withColumn("status", status)


def activation_decision(intent: Column, generation: Column, pointer: Column, target: Column, previous: Column, count_ok: Column, digest_ok: Column) -> Column:
    """What an unfinished activation needs."""
    at_target = pointer.eqNullSafe(target)
    return (
        F.when(intent.isin("completed", "failed", "superseded"), "none")
        .when(generation.isNull(), "fail")
        .when(~digest_ok & at_target, "restore")
        .when(~digest_ok, "supersede")
        .when(at_target & (generation == "active"), "complete")
        .when(at_target & count_ok, "finish")
        .when(at_target, "restore")
        .when(pointer.eqNullSafe(previous) & (generation == "ready") & count_ok, "retry")
        .when(pointer.eqNullSafe(previous), "fail")
        .otherwise("supersede")
    )


def run_cleanup(tasks: DataFrame, points: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(tasks, points) after the oldest ``limit`` open tasks were tried; a point that is gone counts as deleted."""
    order = tasks.filter("status IN ('pending', 'failed')").orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_run"))
    cols = tasks.columns
    out = tasks.join(order.hint("broadcast"), "id", "left")
    run = F.coalesce("_run", F.lit(False))
    done = out.withColumn("attempts", F.when(run, F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("status", F.when(run, "completed").otherwise(F.col("status")))
    return done.select(*cols), points.join(out.filter(run).select("point_id"), "point_id", "left_anti")


def active_identity(generations: DataFrame, pointer: str, identity: dict[str, object]) -> DataFrame:
    """Whether the one active generation is what the pointer and the configuration name."""
    ok = F.col("collection_name").eqNullSafe(pointer)
    for name, value in identity.items():
        ok = ok & F.col(name).eqNullSafe(F.lit(value))
    return generations.filter("status = 'active'").agg(F.count("*").alias("active"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("matches"))
