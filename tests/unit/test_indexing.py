"""Vector tables, embeddings, ranking and paragraph chunks against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from quillstone.operators import aggregates as A
from quillstone.operators import chunking as K
from quillstone.operators import indexing as X
from quillstone.operators import vectors as G

IDENTITY = {"provider": "p", "model": "m", "dimensions": 4, "instruction_version": "q", "indexing_version": "v1"}
PAPERS = "topic_id string, paper_id long, abstract string"


def embedder(c):
    return G.hashed_embedding(c, 4)


def files(root):
    return {(str(f), f.stat().st_mtime_ns) for f in Path(root).rglob("*.parquet")}


def test_only_what_changed_is_embedded_and_written(spark, tmp_path):
    root = str(tmp_path / "index")
    X.create_tables(spark, root)
    ensure = lambda rows, e=embedder: X.ensure_abstract_index(spark.createDataFrame(rows, PAPERS), root, IDENTITY, "c", e, buckets=16)
    first = [("t", k, f"abstract {k}") for k in range(40)] + [("t", 90, " "), ("t", 91, None)]
    assert ensure(first) == {"new": 40}
    seen = files(root)
    assert ensure(first) == {} and files(root) == seen
    second = [("t", 3, "another abstract"), *first[:3], *first[4:], ("u", 3, "another topic")]
    assert ensure(second) == {"new": 1, "changed": 1}
    before = {f for f, _ in seen if "/points/" in f}
    assert len({f for f, _ in files(root) if "/points/" in f} & before) >= len(before) - 2  # other buckets are as they were
    points = {(r["topic_id"], r["paper_id"], r["content_hash"]): r["point_id"] for r in X.read_table(spark, root, "points").collect()}
    old = points[("t", 3, hashlib.sha256(b"abstract 3").hexdigest())]
    assert [(r["point_id"], r["status"]) for r in X.read_table(spark, root, "cleanup").collect()] == [(old, "pending")]
    assert X.run_pending_cleanup(spark, root, buckets=16) == 1 and X.run_pending_cleanup(spark, root, buckets=16) == 0
    assert X.read_table(spark, root, "points").filter(F.col("point_id") == old).count() == 0
    chunks = X.read_table(spark, root, "chunks")
    assert chunks.count() == 41 and chunks.filter("embedding_status != 'completed' OR embedded_content_hash != content_hash").count() == 0


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    X.create_tables(spark, root)
    rows = spark.createDataFrame([("t", k, f"abstract {k}") for k in range(5)], PAPERS)
    whole = X.replace_rows

    def broken(spark, root, name, rows, buckets):
        if name == "points":
            raise OSError("lost")
        whole(spark, root, name, rows, buckets)

    monkeypatch.setattr(X, "replace_rows", broken)
    with pytest.raises(OSError):
        X.ensure_abstract_index(rows, root, IDENTITY, "c", embedder)
    assert {r["embedding_status"] for r in X.read_table(spark, root, "chunks").collect()} == {"indexing"}
    monkeypatch.undo()
    assert X.ensure_abstract_index(rows, root, IDENTITY, "c", embedder) == {"stale": 5}
    assert X.read_table(spark, root, "points").count() == 5
    with pytest.raises(ValueError):
        X.ensure_abstract_index(rows.withColumn("abstract", F.lit("x")), root, IDENTITY, "c", lambda c: F.lit(None).cast("array<double>"))


def test_generations(spark, tmp_path):
    chunks = spark.createDataFrame([("t", k, "pdf", k, f"text {k}", f"h{k}") for k in range(7)], "topic_id string, paper_id long, chunk_type string, chunk_index int, text string, content_hash string")
    build = lambda g, df, e: X.build_generation(df, str(tmp_path), g, IDENTITY, "c", e).first()
    assert (lambda r: (r["status"], r["chunks"], r["indexed_chunks"], r["error_message"]))(build("a", chunks, embedder)) == ("ready", 7, 7, None)
    torn = build("b", chunks, lambda c: F.when(F.col("paper_id") != 3, embedder(c)).when(F.col("paper_id") == 4, F.array(F.lit(1.0))))
    assert (torn["status"], torn["indexed_chunks"]) == ("failed", 6) and "6 points; expected 7" in torn["error_message"]
    assert build("c", chunks.limit(0), embedder)["status"] == "failed"


def test_a_generation_embeds_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(text):
        calls.add(1)
        return [1.0, 0.0, 0.0, 0.0]

    chunks = spark.createDataFrame([("t", k, "pdf", k, f"text {k}", f"h{k}") for k in range(7)], "topic_id string, paper_id long, chunk_type string, chunk_index int, text string, content_hash string")
    assert X.build_generation(chunks, str(tmp_path), "a", IDENTITY, "c", counted).first()["status"] == "ready"
    assert calls.value == 7


def test_hashed_embedding(spark):
    rng = random.Random(2)
    texts = ["", None, " - ", "one", "One one ONE two"] + [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    words = {w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower())}
    for dimension in (1, 7, 64):
        bins = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(dimension)).alias("b")).collect()}
        for r in df.select("k", G.hashed_embedding(F.col("t"), dimension).alias("v")).collect():
            count = Counter(bins[w] for w in re.findall(r"[^\W_]+", (texts[r["k"]] or "").lower()))
            want = np.array([count[b] for b in range(dimension)], dtype=float)
            assert len(r["v"]) == dimension and np.allclose(r["v"], want / (np.linalg.norm(want) or 1))


def test_a_model_as_embedder(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("banana",), ("fig",)], "t string")
    assert sorted(r["embedding"] for r in G.embed(df, "t", 2, G.model_embedding(make)).collect()) == [[3.0, 0.0], [6.0, 3.0]]


def test_near_ties_are_ranked_before_rounding(spark):
    far, near = [1.0, 1e-3], [1.0, 4.5e-4]  # cosines 0.9999995 and 0.9999999
    vectors = spark.createDataFrame([("t", 1, 1, "pdf", far), ("t", 2, 2, "pdf", near)], "topic_id string, paper_id int, point_id int, chunk_type string, embedding array<double>")
    asked = spark.createDataFrame([(1, "t", [1.0, 0.0])], "query_id int, topic_id string, embedding array<double>")
    assert [r["paper_id"] for r in G.search_chunks(asked, vectors, 1).collect()] == [2]
    assert [r["paper_id"] for r in G.rank_papers(asked, vectors, 2).orderBy("rank").collect()] == [2, 1]
    ranked = spark.createDataFrame([("t", 1, 0.5, 1), ("t", 2, 0.5 + 1e-10, 2)], "topic_id string, paper_id int, score double, rank int")
    none = spark.createDataFrame([], "topic_id string, batch int, index int, judge double")
    assert [r["paper_id"] for r in G.blend(ranked, none).orderBy("rank").collect()] == [2, 1]


def plain_chunks(text, size, overlap):
    """The fold over paragraphs with every chunk as one list of words and one of parts."""
    overlap, done, parts = max(0, min(overlap, size - 1)), [], []
    split = lambda x: x.split()
    count = lambda: sum(len(split(p)) for p in parts)
    for p in (x.strip() for x in re.split(r"\n[ \t]*\n", text)):
        n = len(split(p))
        if n == 0:
            continue
        if n <= size and count() + n <= size:
            parts.append(p)
            continue
        room = overlap if n > size else min(overlap, size - n)
        last = split(" ".join(parts))
        carry = last[max(0, len(last) - room) :] if room > 0 else []
        if parts:
            done.append(("\n\n".join(parts), count()))
        if n <= size:
            parts = [x for x in (" ".join(carry), p) if x]
            continue
        lead, at = carry + split(p), 0
        while at + size < len(lead):
            done.append((" ".join(lead[at : at + size]), size))
            at += size - overlap
        parts = [" ".join(lead[at : at + size])]
    return done + ([("\n\n".join(parts), count())] if parts else [])


def test_paragraphs_against_the_plain_fold(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(400):
        paragraphs = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 8, 20, 70]))) for _ in range(rng.randrange(12))]
        texts.append(rng.choice(["\n\n", "\n \t\n", "\n\n\n"]).join(paragraphs))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for size, overlap in ((20, 5), (7, 0), (9, 30), (1, 0)):
        for r in df.select("k", K.paragraph_chunks(F.col("t"), size, overlap).alias("c")).collect():
            assert [(c["text"], c["words"]) for c in r["c"]] == plain_chunks(texts[r["k"]], size, overlap)


def test_paragraphs_are_linear():
    def took(n):
        text = "\n\n".join("some words of a paragraph" for _ in range(n))
        began = time.perf_counter()
        K.pack_paragraphs(text, 60, 10)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 40 * max(took(4000), 0.01)


def test_quantiles_of_merged_sketches(spark):
    rng = np.random.default_rng(1)
    ms = rng.lognormal(3, 1, 30_000)
    rows = [(k % 2, "op", f"2024-01-01 {k % 24:02}:00:00", float(x)) for k, x in enumerate(ms)]
    log = spark.createDataFrame(rows, "service int, operation string, ts string, ms double").withColumn("ts", F.to_timestamp("ts"))
    kept = A.duration_sketches(log)
    assert kept.count() == 24  # every hour has one of the two services
    got = A.duration_quantiles(kept, "operation").first()
    assert got["requests"] == len(ms)
    for q in (50, 95, 99):
        assert abs(np.mean(ms <= got[f"p{q}"]) - q / 100) < 0.01


def test_workers_hold_the_chunks_of_a_few_texts():
    texts = pd.Series([f"a{i} b c\n\nd" for i in range(K.SLICE * 2 + 50)])
    parts = list(K.pack_batches(iter([texts]), 3, 1))
    assert [len(p) for p in parts] == [K.SLICE, K.SLICE, 50]
    assert [[(c["text"], c["words"]) for c in x] for p in parts for x in p] == [K.pack_paragraphs(t, 3, 1) for t in texts]


def test_sections_of_odd_texts(spark):
    odd = ["", None, "# \n#\n##\nx", "\r\n# A\rb\r\n## \u3000 B # \u2003\n \n#\u3000c\nd", "#x\n\u00a0\n#y\nz", " \t# t \n\x1c\n", "###a#\n#!\nq\n"]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, t string")
    got = sorted(tuple(r) for r in K.sections(df, "k", "t").collect())
    assert got == [(2, 0, "", "# \n#\n##\nx"), (3, 1, "A", "b"), (3, 3, "c", "d"), (4, 2, "y", "z"), (5, 1, "t", "\x1c\n"), (6, 2, "!", "q\n")]


def test_a_text_of_many_sections_is_read_once(spark):
    """With the text's lines copied to each section this would be 10,000 times the text."""
    n = 10_000
    df = spark.createDataFrame([(1, "\n".join(f"# s{i}\nw{i} x" for i in range(n)))], "k int, t string")
    out = K.chunk_markdown(df, "k", "t", 60, 10)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["chunk_index"], r["heading"], r["text"], r["words"]) for r in out.collect())
    assert rows == [(i, f"s{i}", f"w{i} x", 2) for i in range(n)]


def test_whole_buckets_are_written_by_the_tasks_that_have_them(spark, tmp_path):
    """Dealt to its bucket's one task, each bucket would come as one file."""
    root = str(tmp_path)
    X.create_tables(spark, root)
    none = F.lit(None).cast("string")
    rows = spark.range(0, 400, 1, 4).select(F.lit("c").alias("collection_name"), F.col("id").cast("string").alias("point_id"), F.lit("t").alias("topic_id"), F.col("id").alias("paper_id"), none.alias("reason"), F.lit("pending").alias("status"))
    rows.write.parquet(f"{root}/new")
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        X.replace_rows(spark, root, "cleanup", spark.read.parquet(f"{root}/new"), 2)
        X.replace_rows(spark, root, "cleanup", spark.read.parquet(f"{root}/new").filter("paper_id < 100").withColumn("status", F.lit("completed")), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert len(list((tmp_path / "cleanup" / "bucket=0").glob("*.parquet"))) > 1
    got = {(r["paper_id"], r["status"]) for r in X.read_table(spark, root, "cleanup").collect()}
    assert got == {(i, "completed" if i < 100 else "pending") for i in range(400)}
