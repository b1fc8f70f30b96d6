"""Queries of chunking (K) and vectors (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import indexing as X
from ..operators import vectors as G
from ..operators.reads import authors_by_paper
from ..scratch import scratch_path
from .views import LINKS, PAPERS, links, papers, table

IDENT = {"provider": "ollama", "model": "m", "dimensions": 64, "instruction_version": "q", "indexing_version": "v1"}


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("paper_id"), F.col("label").alias("topic_id"), F.when(F.col("vec_id") % 2 == 1, "pdf").otherwise("abstract").alias("chunk_type"), "embedding")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return e.select(F.col("label").alias("query_id"), F.col("label").alias("topic_id"), "embedding")


_VEC = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT label, e AS qe FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT label AS topic_id, vec_id, list_cosine_similarity(e, qe) AS score FROM v JOIN q USING (label))"""


def rank_topics_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the papers of every topic, ranked by their vectors, with their authors."""
    ranked = G.rank_papers(_queries(spark, sf), _vectors(spark, sf), 12)
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))
    own = links(spark, sf).join(ranked.select("paper_id").distinct(), "paper_id", "left_semi")
    out = ranked.join(authors_by_paper(own, names), "paper_id", "left")
    return out.select("topic_id", "paper_id", F.round("score", 6).alias("score"), "rank", F.coalesce(F.array_join("authors", "; "), F.lit("")).alias("authors"))


_FLAGSHIP = f"""WITH {_VEC}, {LINKS}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, vec_id) <= 12),
a AS (SELECT paper_id, string_agg(s_name, '; ' ORDER BY position, author_id) AS authors FROM links JOIN supplier ON s_suppkey = author_id GROUP BY 1)
SELECT topic_id, vec_id AS paper_id, round(score, 6) AS score, row_number() OVER (PARTITION BY topic_id ORDER BY t.score DESC, vec_id)::INT AS rank, coalesce(authors, '') AS authors FROM t LEFT JOIN a ON a.paper_id = vec_id"""


def search_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return G.search_chunks(_queries(spark, sf), _vectors(spark, sf)).select("topic_id", "paper_id", F.round("score", 6).alias("score"), "rank")


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    return K.hashed(K.chunk_words(table(spark, sf, "documents"), "doc_id", "text", 50, 10)).select("doc_id", "chunk_index", "words", "content_hash")


_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')"
_CHUNKED = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 50) / 40.0))::BIGINT)) AS i FROM w WHERE len(w) > 0)"


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    marked = F.transform("l", lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# Section "), (F.floor(i / 3) + 1).cast("string"), F.lit("\n"), x)).otherwise(x))
    return d.select("doc_id", F.array_join(marked, "\n\n").alias("markdown"))


def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("t"))
    out = d.select("doc_id", F.posexplode(K.paragraph_chunks(F.col("t"), 60, 10)).alias("chunk_index", "c"))
    return out.select("doc_id", "chunk_index", "c.text", "c.words")


def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return K.chunk_markdown(_markdown(spark, sf), "doc_id", "markdown", 60, 10)


def _chunk_state(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_words(spark, sf).withColumn("is_current", F.col("doc_id") % 4 != 0)


def chunk_refresh(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunk_state(spark, sf)
    new = c.filter("(doc_id + chunk_index) % 5 != 4").select("doc_id", "chunk_index", F.when(F.col("chunk_index") % 2 == 1, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return K.plan_refresh(c.filter("(doc_id + chunk_index) % 7 != 3"), new, ["doc_id"])


def pdf_index_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).select("paper_id", F.when(F.col("paper_id") % 5 != 0, F.concat(F.lit("http://x/"), F.col("external_id"))).alias("pdf_url"))
    c = _chunk_state(spark, sf).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("paper_id"), F.when(F.col("chunk_index") == 0, "abstract").otherwise("pdf").alias("chunk_type"), "is_current")
    return K.plan_pdf_index(p, c)


def vector_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    broken = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    return G.vector_faults(e.select("vec_id", broken.alias("embedding")), "vec_id", 64)


def query_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(G.query_text(F.lit("find"), F.col("text")), 256).alias("hash"))


def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    out = G.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", 16)
    return out.select("doc_id", F.size("embedding").alias("n"), F.round(G.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    ranked = G.rank_papers(_queries(spark, sf), _vectors(spark, sf), 50)
    rows = ranked.select("topic_id", F.floor((F.col("rank") - 1) / 10).cast("int").alias("batch"), ((F.col("rank") - 1) % 10 + 1).cast("int").alias("index"), ((F.col("paper_id") * 37 % 100) / 100).alias("judge"))
    index = F.when(((F.col("topic_id") + F.col("batch")) % 3 == 0) & (F.col("index") == 2), 1).otherwise(F.col("index"))
    return G.blend(ranked, rows.withColumn("index", index)).withColumn("score", F.round("score", 8))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("point_id", "topic_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


def points_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of every third id over those of even ones; some of another identity, without one, without a hash or too short."""
    k = F.col("paper_id")
    v = _vectors(spark, sf).withColumns({"topic_id": F.col("topic_id").cast("string"), "chunk_index": F.lit(0), "text": F.concat(F.lit("t"), k.cast("string"))})
    ident = {c: F.lit(x) for c, x in IDENT.items()}
    first, faults = G.upsert_points(spark.createDataFrame([], "point_id string, topic_id string, paper_id long, content_hash string, size int"), v.filter(k % 2 == 0).withColumns(ident | {"content_hash": F.lit(None).cast("string"), "size": F.lit(1)}), IDENT)
    new = v.filter(k % 3 == 0).withColumns(ident).withColumn("model", F.when(k % 5 == 0, "other").otherwise(F.col("model")))
    new = new.withColumns({c: F.when(k % 9 != 0, F.col(c)) for c in IDENT}).withColumns({"content_hash": F.when(k % 4 == 0, F.sha2("text", 256)), "embedding": F.when(k % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")), "size": F.lit(2)})
    points, faults = G.upsert_points(first, new, IDENT)
    stored = points.select("paper_id", "size", F.col("content_hash").alias("detail"))
    return stored.unionByName(faults.select("paper_id", F.lit(0).alias("size"), F.col("fault").alias("detail")))


def points_scroll(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred points of a topic, and how many ids there are in all."""
    p = _vectors(spark, sf)
    return G.scroll(p, F.col("topic_id") == 3, 100).select("point_id").join(G.point_ids(p).agg(F.count("*").alias("n")).hint("broadcast"))


def points_delete(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    return G.delete_points(p, p.filter("point_id % 3 = 0"), F.col("topic_id") == 4).select("point_id", "topic_id")


def points_present(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select((F.col("doc_id") * 3).alias("point_id"))
    return G.existing_points(_points(spark, sf), ids)


def _abstract_chunks(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf).filter("paper_id % 5 != 0")
    h = F.sha2("abstract", 256)
    stored = F.when(F.col("paper_id") % 7 == 0, F.reverse(h)).otherwise(h)
    return p.select("topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), stored.alias("content_hash"), F.when(F.col("paper_id") % 11 == 0, "pending").otherwise("completed").alias("embedding_status"), stored.alias("embedded_content_hash"), F.lit("ollama").alias("embedding_provider"), F.when(F.col("paper_id") % 13 == 0, "old").otherwise("m").alias("embedding_model"), F.lit(64).alias("embedding_dimensions"), F.lit("q").alias("instruction_version"), F.lit("v1").alias("indexing_version"), F.lit("c").alias("qdrant_collection"), F.col("paper_id").alias("qdrant_point_id"))


def current_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _abstract_chunks(spark, sf).select("paper_id", G.is_current(IDENT, "c").alias("current"))


def abstract_plan(spark: SparkSession, sf: str) -> DataFrame:
    points = papers(spark, sf).filter("paper_id % 17 != 0").select(F.col("paper_id").alias("point_id"))
    return G.abstract_plan(papers(spark, sf), _abstract_chunks(spark, sf), points, G.is_current(IDENT, "c"))


def collection_check(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    whole = G.collection_check(table(spark, sf, "embeddings"), 64, 500).select(F.lit(-1).alias("label"), "n", "low", "high")
    return e.unionByName(whole)


def generation_build(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations over all documents: one whole, one in which every ninth text is not embedded."""
    chunks = papers(spark, sf).select("topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), F.col("abstract").alias("text"), F.sha2("abstract", 256).alias("content_hash"))
    root = scratch_path(spark, "generations")
    plain = lambda c: G.hashed_embedding(c, 64)
    rows = [X.build_generation(chunks, root, g, IDENT, f"c_{g}", e) for g, e in (("whole", plain), ("torn", lambda c: F.when(F.col("paper_id") % 9 != 0, plain(c))))]
    points = spark.read.schema(f"{X.POINTS}, gen string").parquet(f"{root}/points").groupBy("gen").agg(F.count_distinct("point_id").alias("points"))
    return rows[0].unionByName(rows[1]).join(points.withColumnRenamed("gen", "generation").hint("broadcast"), "generation")


def abstract_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of four fifths of the papers, brought up to date with all papers of which every seventh has changed, and once more."""
    p, root = papers(spark, sf).select("topic_id", "paper_id", "abstract"), scratch_path(spark, "index")
    X.create_tables(spark, root)
    ensure = lambda rows: X.ensure_abstract_index(rows, root, IDENT, "c", lambda c: G.hashed_embedding(c, 64), buckets=8)
    now = p.withColumn("abstract", F.when(F.col("paper_id") % 7 == 0, F.concat(F.lit("new "), "abstract")).otherwise(F.col("abstract")))
    ensure(p.filter("paper_id % 5 != 0"))
    ensure(now)
    repeated = sum(ensure(now).values())
    X.run_pending_cleanup(spark, root, buckets=8)
    chunks, points, tasks = (X.read_table(spark, root, n) for n in ("chunks", "points", "cleanup"))
    rows = chunks.select(F.lit("chunk").alias("kind"), "paper_id", "content_hash", F.col("embedding_status").alias("status"))
    rows = rows.unionByName(points.select(F.lit("point").alias("kind"), "paper_id", "content_hash", F.size("embedding").cast("string").alias("status")))
    rows = rows.unionByName(tasks.select(F.lit("cleanup").alias("kind"), "paper_id", F.lit(None).cast("string").alias("content_hash"), "status"))
    return rows.withColumn("repeated", F.lit(repeated))


def snapshot_digest(spark: SparkSession, sf: str) -> DataFrame:
    return G.snapshot_digest(chunk_words(spark, sf), ["doc_id", "chunk_index", "content_hash"])


_DIGEST = f"""WITH {_CHUNKED}, r AS (SELECT sha256(doc_id || chr(0) || i || chr(0) || sha256(array_to_string(w[i * 40 + 1:i * 40 + 50], ' '))) AS h FROM k),
p AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1)
SELECT sha256(string_agg(p || d, '' ORDER BY p)) AS digest FROM p"""


def _activations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.floor(k / n) % len(v) + 1).cast("int"))
    return o.select(k.alias("id"), pick(1, "pending", "alias_switched", "completed", "failed").alias("intent"), pick(4, "ready", "active", None, "building").alias("generation"), pick(16, "t", "p", "x", None).alias("pointer"), (k % 5 != 0).alias("count_ok"), (k % 7 != 0).alias("digest_ok"))


_ACT = """a AS (SELECT o_orderkey AS id, ['pending', 'alias_switched', 'completed', 'failed'][o_orderkey % 4 + 1] AS intent, ['ready', 'active', NULL, 'building'][(o_orderkey // 4) % 4 + 1] AS generation,
  ['t', 'p', 'x', NULL][(o_orderkey // 16) % 4 + 1] AS pointer, o_orderkey % 5 <> 0 AS count_ok, o_orderkey % 7 <> 0 AS digest_ok FROM orders)"""


def activation_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = G.activation_decision(F.col("intent"), F.col("generation"), F.col("pointer"), F.lit("t"), F.lit("p"), F.col("count_ok"), F.col("digest_ok"))
    return _activations(spark, sf).select("id", d.alias("decision"))


def activation_swap(spark: SparkSession, sf: str) -> DataFrame:
    return _activations(spark, sf).select("id", G.activate(F.col("pointer"), F.lit("p"), F.lit("t")).alias("pointer"))


def activation_finalize(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "P", "active").otherwise("ready").alias("status"))
    return G.finalize(g, "7", F.lit("d"), F.lit("d"))


def cleanup_run(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("point_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.lit(0).alias("attempts"), F.col("o_orderdate").alias("created_at"))
    tasks, points = G.run_cleanup(o, o.select("point_id"), 100)
    return tasks.groupBy("status", "attempts").agg(F.count("*").alias("n")).unionByName(points.agg(F.lit("points").alias("status"), F.lit(-1).alias("attempts"), F.count("*").alias("n")))


def active_identity(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") == 3, "active").otherwise("retired").alias("status"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("collection_name"), F.lit("m").alias("model"))
    return G.active_identity(g, "c3", {"model": "m"})


_BLEND = f"""WITH {_VEC}, r AS (SELECT topic_id, vec_id AS paper_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 50),
b AS (SELECT *, (rank - 1) // 10 AS batch, (paper_id * 37 % 100) / 100.0::DOUBLE AS judge FROM r),
n AS (SELECT topic_id, batch, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT b.topic_id, paper_id, (CASE WHEN (b.topic_id + b.batch) % 3 <> 0 OR n < 2 THEN 0.3::DOUBLE * score + 0.7::DOUBLE * judge ELSE score END) AS score FROM b JOIN n USING (topic_id, batch))
SELECT topic_id, paper_id, round(score, 8) AS score, row_number() OVER (PARTITION BY topic_id ORDER BY x.score DESC, paper_id)::INT AS rank FROM x"""

QUERIES = {
    "rank_topics_topk": (rank_topics_topk, _FLAGSHIP),
    "search_chunks": (search_chunks, f"WITH {_VEC} SELECT topic_id, vec_id AS paper_id, round(score, 6) AS score, row_number() OVER (PARTITION BY topic_id ORDER BY s.score DESC, vec_id)::INT AS rank FROM s WHERE vec_id % 2 = 1 QUALIFY rank <= 12"),
    "chunk_words": (chunk_words, f"WITH {_CHUNKED} SELECT doc_id, i::INT AS chunk_index, len(w[i * 40 + 1:i * 40 + 50])::INT AS words, sha256(array_to_string(w[i * 40 + 1:i * 40 + 50], ' ')) AS content_hash FROM k"),
    "chunk_paragraphs": (chunk_paragraphs, None),
    "chunk_markdown": (chunk_markdown, None),
    "chunk_refresh": (chunk_refresh, f"WITH {_CHUNKED}, o AS (SELECT doc_id, i FROM k WHERE (doc_id + i) % 7 <> 3), n AS (SELECT doc_id, i FROM k WHERE (doc_id + i) % 5 <> 4), j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.i, n.i)::INT AS chunk_index, CASE WHEN n.i IS NULL THEN 'removed' WHEN o.i IS NULL THEN 'added' WHEN n.i % 2 = 1 THEN 'replaced' ELSE 'retained' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.i = n.i) SELECT *, action <> 'removed' AND NOT (action = 'retained' AND doc_id % 4 <> 0) AS embed FROM j"),
    "pdf_index_plan": (pdf_index_plan, f"WITH {PAPERS}, {_CHUNKED}, p AS (SELECT DISTINCT doc_id FROM k WHERE i > 0 AND doc_id % 3 = 0 AND doc_id % 4 <> 0) SELECT paper_id, 'http://x/' || external_id AS pdf_url FROM papers WHERE paper_id % 5 <> 0 AND paper_id NOT IN (SELECT doc_id FROM p)"),
    "vector_checks": (vector_checks, "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'empty' WHEN vec_id % 11 = 0 THEN 'dimension' ELSE 'not finite' END AS fault FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0"),
    "query_text": (query_text, "SELECT doc_id, sha256('Instruct: find' || chr(10) || 'Query:' || text) AS hash FROM documents"),
    "hashed_embedding": (hashed_embedding, "SELECT doc_id, 16 AS n, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents"),
    "rerank_blend": (rerank_blend, _BLEND),
    "points_upsert": (points_upsert, "WITH d AS (SELECT vec_id AS k, sha256('t' || vec_id) AS h FROM embeddings), n AS (SELECT k, h, CASE WHEN k % 5 = 0 AND k % 9 <> 0 THEN 'embedding identity mismatch: got ollama:other:64:q:v1 want ollama:m:64:q:v1' WHEN k % 7 = 0 THEN 'validate vector for paper ' || k || ' chunk 0: dimension' END AS fault FROM d WHERE k % 3 = 0) SELECT k AS paper_id, 0 AS size, fault AS detail FROM n WHERE fault IS NOT NULL UNION ALL SELECT k, 2, h FROM n WHERE fault IS NULL UNION ALL SELECT k, 1, h FROM d WHERE k % 2 = 0 AND k NOT IN (SELECT k FROM n WHERE fault IS NULL)"),
    "points_scroll": (points_scroll, "SELECT vec_id AS point_id, (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100"),
    "points_delete": (points_delete, "SELECT vec_id AS point_id, label AS topic_id FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 4"),
    "points_present": (points_present, "SELECT doc_id * 3 AS point_id FROM documents WHERE doc_id * 3 IN (SELECT vec_id FROM embeddings)"),
    "current_chunks": (current_chunks, "SELECT doc_id AS paper_id, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS current FROM documents WHERE doc_id % 5 <> 0"),
    "abstract_plan": (abstract_plan, "WITH p AS (SELECT source AS topic_id, doc_id AS paper_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'stale' WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'ok' END AS action FROM documents WHERE trim(text) <> '') SELECT *, CASE WHEN action = 'changed' THEN paper_id END AS cleanup_point FROM p"),
    "collection_check": (collection_check, "SELECT label, count(*) AS n, min(len(embedding))::INT AS low, max(len(embedding))::INT AS high FROM embeddings GROUP BY label UNION ALL SELECT -1, count(*), min(len(embedding))::INT, max(len(embedding))::INT FROM embeddings"),
    "generation_build": (generation_build, "WITH g AS (SELECT 'whole' AS generation, count(*) AS indexed_chunks FROM documents UNION ALL SELECT 'torn', count(*) FILTER (WHERE doc_id % 9 <> 0) FROM documents), n AS (SELECT count(*) AS chunks FROM documents) SELECT generation, 'c_' || generation AS collection_name, chunks, indexed_chunks, CASE WHEN chunks = indexed_chunks THEN 'ready' ELSE 'failed' END AS status, CASE WHEN chunks <> indexed_chunks THEN 'rebuilt collection contains ' || indexed_chunks || ' points; expected ' || chunks || '; activation refused' END AS error_message, indexed_chunks AS points FROM g, n"),
    "abstract_index": (abstract_index, "WITH d AS (SELECT doc_id AS paper_id, doc_id % 7 = 0 AS changed, sha256(CASE WHEN doc_id % 7 = 0 THEN 'new ' || text ELSE text END) AS content_hash FROM documents WHERE trim(CASE WHEN doc_id % 7 = 0 THEN 'new ' || text ELSE text END) <> '') SELECT 'chunk' AS kind, paper_id, content_hash, 'completed' AS status, 0 AS repeated FROM d UNION ALL SELECT 'point', paper_id, content_hash, '64', 0 FROM d UNION ALL SELECT 'cleanup', doc_id, NULL, 'completed', 0 FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0 AND trim(text) <> ''"),
    "snapshot_digest": (snapshot_digest, _DIGEST),
    "activation_decisions": (activation_decisions, f"WITH {_ACT} SELECT id, CASE WHEN intent IN ('completed', 'failed') THEN 'none' WHEN generation IS NULL THEN 'fail' WHEN NOT digest_ok THEN CASE WHEN coalesce(pointer, '') = 't' THEN 'restore' ELSE 'supersede' END WHEN coalesce(pointer, '') = 't' THEN CASE WHEN generation = 'active' THEN 'complete' WHEN count_ok THEN 'finish' ELSE 'restore' END WHEN coalesce(pointer, '') = 'p' THEN CASE WHEN generation = 'ready' AND count_ok THEN 'retry' ELSE 'fail' END ELSE 'supersede' END AS decision FROM a"),
    "activation_swap": (activation_swap, f"WITH {_ACT} SELECT id, CASE WHEN pointer IN ('t', 'p') THEN 't' END AS pointer FROM a"),
    "activation_finalize": (activation_finalize, "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey = 7 THEN 'active' WHEN o_orderstatus = 'P' THEN 'retired' ELSE 'ready' END AS status FROM orders"),
    "cleanup_run": (cleanup_run, "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) <= 100 AND o_orderstatus <> 'F' AS run FROM orders) SELECT CASE WHEN run OR o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status, run::INT AS attempts, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'points', -1, count(*) FROM o WHERE NOT run"),
    "active_identity": (active_identity, "SELECT count(*) AS active, true AS matches FROM supplier WHERE s_suppkey = 3"),
}
