import json
import os
import random

import pytest
from pyspark.sql import functions as F
from quillstone.operators import chunking as K
from quillstone.operators import graph
from quillstone.operators import judged as H
from quillstone.operators import reads as R
from quillstone.operators import resolve as C
from quillstone.operators import tables as D
from quillstone.operators import vectors as G
from quillstone.plans import resolve as plans
from quillstone.operators.graph import stars
from quillstone.sources import records as S


def chunks(spark, text, size, overlap):
    row = spark.createDataFrame([(text,)], "t string").select(K.paragraph_chunks(F.col("t"), size, overlap)).first()[0]
    return [(c["text"], c["words"]) for c in row]


def test_paragraphs(spark):
    assert chunks(spark, "ebb and flood\n\nslack\n \nspring tide rises", 5, 2) == [("ebb and flood\n\nslack", 4), ("flood slack\n\nspring tide rises", 5)]
    assert [n for _, n in chunks(spark, "salt " * 11, 5, 2)] == [5, 5, 5]
    assert chunks(spark, "a b", 0, 0) == []
    assert chunks(spark, "", 4, 1) == []


def test_markdown(spark):
    md = "# Harbours\n\nthe quay\n\n## Moorings\n\nropes hold\n#\nfast"
    rows = K.chunk_markdown(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md", 50, 0).orderBy("chunk_index").collect()
    assert [r["heading"] for r in rows] == ["Harbours", "Moorings"]
    assert "#" in rows[1]["text"]


def record(k, source, **fields):
    base = {"topic_id": "t", "ordinal": k, "id": str(k), "title": "", "abstract": "", "source": source, "external_id": f"x{k}", "url": "", "pdf_url": "", "year": 0, "venue": "", "doi": "", "arxiv_id": "", "authors": []}
    return base | fields


def resolved(spark, rows):
    return [r.asDict(True) for r in C.reconcile(spark.createDataFrame(rows, C.RECORD)).orderBy("ordinal").collect()]


def test_doi_merge(spark):
    a = record(0, "semantic_scholar", doi="10.77/TIDE.4", title="Tide tables", year=2019)
    b = record(1, "arxiv", doi="https://doi.org/10.77/tide.4", pdf_url="http://p")
    out = resolved(spark, [a, b])
    assert len(out) == 1 and out[0]["source"] == "semantic_scholar" and out[0]["pdf_url"] == "http://p"


def test_title_year_author(spark):
    own = [{"name": "Runa Vik", "author_id": None}]
    a = record(0, "semantic_scholar", title="Tidal Gauges; a survey", year=2017, authors=own)
    b = record(1, "arxiv", title=" tidal gauges   A survey", year=2017, authors=own)
    assert len(resolved(spark, [a, b])) == 1
    assert len(resolved(spark, [a | {"authors": []}, b | {"authors": []}])) == 2


def test_components_equal_whole_loop(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        name = f"author {rng.randrange(4)}"
        rows.append(record(k, "semantic_scholar" if k < 150 else "arxiv", title=f"title {rng.randrange(60)}", year=rng.choice([0, 2020, 2021]), doi=rng.choice(["", f"10.1/{rng.randrange(80)}"]), arxiv_id=rng.choice(["", f"24.{rng.randrange(80)}v1"]), authors=[{"name": name, "author_id": None}]))
    whole = C.reconcile_in_order([dict(r, authors=[dict(a) for a in r["authors"]]) for r in rows])
    got = resolved(spark, rows)
    assert [(r["ordinal"], r["doi"], r["arxiv_id"], r["year"]) for r in got] == [(r["ordinal"], r["doi"], r["arxiv_id"], r["year"]) for r in sorted(whole, key=lambda r: r["ordinal"])]


def whole_loop(rows):
    out = []
    for topic in {r["topic_id"] for r in rows}:
        own = sorted((r for r in rows if r["topic_id"] == topic), key=lambda r: r["ordinal"])
        out += C.reconcile_in_order([dict(r, year=r["year"] or 0, authors=[dict(a) for a in r["authors"]]) for r in own])
    return sorted(out, key=lambda r: (r["topic_id"], r["ordinal"]))


def test_sparse_records_equal_the_whole_loop(spark):
    """Titles, years, authors and ids are often missing, so merged papers get combinations that no record has."""
    rng = random.Random(11)
    rows = []
    for k in range(500):
        pick = lambda v, p=0.6: v if rng.random() < p else ""
        authors = [{"name": rng.choice(["Ann", "Bo", "ann ", "", "Cy"]), "author_id": pick(f"i{k}", 0.3) or None} for _ in range(rng.randrange(3))]
        rows.append(record(k, rng.choice(["semantic_scholar", "arxiv"]), title=pick(f"title {rng.randrange(25)}"), year=rng.choice([0, 2020, 2021]), doi=pick(f"10.1/{rng.randrange(120)}", 0.3), arxiv_id=pick(f"24.{rng.randrange(120)}", 0.3), external_id=pick(f"x{rng.randrange(300)}", 0.7), authors=authors, venue=pick(f"v{k}", 0.3)))
    df = spark.createDataFrame(rows, C.RECORD)
    assert [r.asDict(True) for r in C.reconcile(df).orderBy("topic_id", "ordinal").collect()] == whole_loop(rows)


def test_one_identity_of_any_size_merges_alike(spark):
    rng = random.Random(5)
    rows = []
    for k in range(240):
        authors = [{"name": rng.choice(["Ann", "Bo", " ann", "", "Cy", "Di"]), "author_id": rng.choice([None, "", f"i{k}"])} for _ in range(rng.randrange(4))]
        rows.append(record(k, rng.choice(["semantic_scholar", "arxiv"]), id=rng.choice(["", str(k)]), title=rng.choice(["", f"t{k % 3}"]), year=rng.choice([0, 2001]), doi=f"10.5/{k % 6}", venue=rng.choice(["", f"v{k}"]), authors=authors))
    df = spark.createDataFrame(rows, C.RECORD)
    many, one = (sorted((r.asDict(True) for r in C.reconcile(df, n).collect()), key=lambda r: r["ordinal"]) for n in (1, 10**6))
    assert many == one == whole_loop(rows)


def test_a_common_title_joins_nothing(spark):
    rows = [record(k, "arxiv" if k % 2 else "semantic_scholar", title="Editorial" if k % 3 == 0 else f"title {k}", year=2020, authors=[{"name": f"author {k}", "author_id": None}]) for k in range(300)]
    df = spark.createDataFrame(rows, C.RECORD)
    assert C.components(df).groupBy("component").count().agg(F.max("count")).first()[0] == 1


def test_keys_of_one_record_link_nothing_and_folding_starts_no_group(spark, monkeypatch, capsys):
    seen = []
    monkeypatch.setattr(C, "stars", lambda edges, **how: seen.append(edges.count()) or stars(edges, **how))
    own = [{"name": "Runa Vik", "author_id": None}]
    rows = [record(k, "arxiv", doi=f"10.1/{k // 2 if k < 4 else k}", title=f"t{k}", year=2000, authors=own) for k in range(9)]
    out = C.reconcile(spark.createDataFrame(rows, C.RECORD))
    assert seen == [2] and sorted(r["ordinal"] for r in out.collect()) == [0, 2, 4, 5, 6, 7, 8]
    out.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_citations_are_spread_by_their_number(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)] * 2, "citing long, cited long")
    monkeypatch.setattr(C, "TASK_ROWS", 20)
    assert C.spread(edges) == 44
    out = C.citation_degrees(edges, C.spread(edges))
    assert out.rdd.getNumPartitions() == 44
    assert sorted(map(tuple, out.collect())) == [(k, k, 29 - k) for k in range(30)]


def test_quota(spark):
    q = spark.createDataFrame([("t", k, f"q{k}") for k in range(3)], "topic_id string, position int, query string")
    rows = C.allocate_quota(q, 10).collect()
    assert len(rows) == 6 and sorted(r["quota"] for r in rows) == [3, 3, 3, 3, 4, 4]


def test_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["a"]: r["b"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_stars_that_are_settled_take_no_round(spark, monkeypatch):
    star = [(k, 0) for k in range(1, 50)] + [(101, 100)]
    assert graph._settled(spark.createDataFrame(star, "a long, b long")) == (50, True)
    assert not graph._settled(spark.createDataFrame([*star, (100, 7)], "a long, b long"))[1]
    monkeypatch.setattr(graph, "_large_star", None)
    assert sorted(map(tuple, stars(spark.createDataFrame([(b, a) for a, b in star], "a long, b long")).collect())) == star


def test_rank_limit(spark):
    row = spark.range(1).select(G.rank_limit(F.lit(75), 0).alias("a"), G.rank_limit(F.lit(75), 60).alias("b"), G.rank_limit(F.lit(0), 5).alias("c")).first()
    assert tuple(row) == (75, 60, 1)


def test_rerank_faults(spark):
    rows = [("a", 3, 0.5), ("a", 1, 0.5), ("b", 1, 0.5), ("c", 1, float("nan")), ("c", 2, 0.1), ("d", 1, float("inf")), ("d", 2, 0.1), ("e", 1, 0.1), ("e", 2, 0.2)]
    scores = spark.createDataFrame(rows, "batch string, index int, score double")
    sizes = spark.createDataFrame([(x, 2) for x in "abcdef"], "batch string, n int")
    assert {r["batch"]: r["fault"] for r in H.rerank_faults(scores, sizes).collect()} == {"a": "index", "b": "incomplete", "c": "score", "d": "score", "f": "empty"}


@pytest.mark.parametrize("bad", [0, -1, 9, 1])
def test_gap_refs_rejected(spark, bad):
    ranked = spark.createDataFrame([("t", 1, "p1"), ("t", 2, "p2")], "topic_id string, rank int, paper_id string")
    gaps = spark.createDataFrame([("t", 1, [2, 1]), ("t", 2, [1, bad])], "topic_id string, gap int, evidence_indices array<int>")
    assert H.resolve_gap_refs(gaps, ranked).count() == 0
    good = H.resolve_gap_refs(gaps.filter("gap = 1"), ranked).first()
    assert good["evidence"] == "p2,p1"


def test_digest_changes(spark):
    rows = [(k, f"text {k}") for k in range(50)]
    digest = lambda data: G.snapshot_digest(spark.createDataFrame(data, "id int, text string"), ["id", "text"]).first()[0]
    first = digest(rows)
    assert first == digest(rows[::-1]) and first != digest(rows[:-1] + [(49, "other")])


def test_shared_paper_has_one_id_and_two_memberships(spark):
    cols = "topic_id string, paper_id string, discovery_source string, score double"
    old = spark.createDataFrame([("t1", "p", "a", 0.5)], cols)
    out = D.upsert_memberships(old, spark.createDataFrame([("t1", "p", "b", None), ("t2", "p", "b", None)], cols)).orderBy("topic_id").collect()
    assert [tuple(r) for r in out] == [("t1", "p", "b", 0.5), ("t2", "p", "b", None)]


def test_delta_rows_apply_in_order(spark):
    old = spark.createDataFrame([("s", "x", 1, "old", 5)], "source string, external_id string, id int, title string, created_at int")
    delta = spark.createDataFrame([(1, "s", "x", 9, "first", 6), (3, "s", "x", 8, "last", 8), (2, "s", "x", 7, "second", 7), (1, "s", "y", 2, "a", 6), (2, "s", "y", 3, None, 7)], "ordinal int, source string, external_id string, id int, title string, created_at int")
    for d in (delta, delta.orderBy(F.desc("ordinal")).repartition(3)):
        got = sorted(tuple(r) for r in D.upsert_papers(old, d).collect())
        assert got == [("s", "x", 1, "last", 5), ("s", "y", 2, None, 6)]
    cols = "topic_id string, paper_id string, discovery_source string, score double"
    twice = spark.createDataFrame([("t", "p", "b", None, 2), ("t", "p", "a", None, 1)], cols + ", ordinal int")
    assert [tuple(r) for r in D.upsert_memberships(spark.createDataFrame([], cols), twice).collect()] == [("t", "p", "b", None)]
    scores = spark.createDataFrame([("t", "p", "a", 0.4, 1), ("t", "p", "b", 0.9, 2)], cols + ", ordinal int")
    assert [tuple(r) for r in D.upsert_memberships(spark.createDataFrame([], cols), scores).collect()] == [("t", "p", "b", 0.4)]
    with pytest.raises(Exception, match="a key repeats"):
        D.upsert_memberships(spark.createDataFrame([], cols), scores.drop("ordinal")).collect()
    chunk = "topic_id string, paper_id int, chunk_type string, chunk_index int, id string, content_hash string, embedding_status string, embedded_content_hash string"
    chunks = spark.createDataFrame([("t", p, "pdf", 0, "i", "h1", "completed", "h1") for p in (1, 2, 3)], chunk)
    changes = [(1, "h1", 1), (1, "h2", 2), (1, "h1", 3), (2, "h1", 1), (2, "h1", 2), (3, "h2", 1)]
    moved = spark.createDataFrame([("t", p, "pdf", 0, "j", h, k) for p, h, k in changes], "topic_id string, paper_id int, chunk_type string, chunk_index int, id string, content_hash string, ordinal int")
    assert sorted(tuple(r)[4:] for r in D.upsert_chunks(chunks, moved).collect()) == [("i", "h1", "completed", "h1"), ("i", "h1", "pending", None), ("i", "h2", "pending", None)]
    stages = spark.createDataFrame([(1, "a", 2, "failed", "t0", "bad")], "run_id int, stage string, attempt int, status string, completed_at string, error_message string")
    started = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "run_id int, stage string")
    assert sorted((r["run_id"], r["attempt"], r["status"]) for r in D.start_stages(stages, started).collect()) == [(1, 4, "running"), (2, 3, "running"), (3, 1, "running")]
    topics = spark.createDataFrame([("t", "new", "s", 0.0, None, None)], "topic_id string, status string, current_stage string, progress double, error_message string, completed_at int")
    changes = spark.createDataFrame([("t", "completed", "report", 1.0, None, 4, 1), ("t", "completed", "report", 1.0, None, 6, 2), ("t", "failed", "index", 0.5, "late", 9, 3)], "topic_id string, status string, current_stage string, progress double, error_message string, at int, ordinal int")
    assert [tuple(r) for r in D.update_topics(topics, changes).collect()] == [("t", "failed", "index", 0.5, "late", 4)]
    sets = spark.createDataFrame([("t", 1.0, 2), ("t", 0.5, 1)], "topic_id string, progress double, ordinal int")
    assert [r["progress"] for r in D.update_columns(topics, sets, ["topic_id"], ["progress"]).collect()] == [1.0]


def test_no_limit_ranks_every_paper(spark):
    vectors = spark.createDataFrame([("t", k, k, "abstract", [1.0, 0.1 * k]) for k in range(5)], "topic_id string, paper_id int, point_id int, chunk_type string, embedding array<double>")
    asked = spark.createDataFrame([(1, "t", [1.0, 0.0])], "query_id int, topic_id string, embedding array<double>")
    for most, n in ((0, 5), (-1, 5), (2, 2), (9, 5)):
        assert [r["paper_id"] for r in G.rank_papers(asked, vectors, most).orderBy("rank").collect()] == list(range(n))


def test_lookup_and_conversion(spark):
    found = S.lookup_by_ids(spark.createDataFrame([("a", None), ("b", "x")], "id string, title string"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert {r["id"]: r["error"] for r in found.collect()} == {"a": None, "b": None, "c": "no record for c"}
    rows = [("success", True, None), ("success", False, True), ("success", False, False), ("success", None, None), ("partial_success", True, None), ("skipped", True, True), ("failure", True, True), ("odd", True, None), (None, True, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, status string, useful boolean, ocr boolean").orderBy("k")
    of = lambda policy: [r[0] for r in df.select(S.classify_conversion(F.col("status"), F.col("useful"), F.col("ocr"), policy)).collect()]
    assert of("fallback") == ["ok", "ocr", "rejected", "rejected", "partial", "error", "error", "unknown", "unknown"]
    assert of("never") == ["ok", "rejected", "rejected", "rejected", "partial", "error", "error", "unknown", "unknown"]
    assert spark.range(1).select(S.join_warnings(F.array(F.lit("abcé"), F.lit("xyz")), 4)).first()[0] == "abc; xyz"


def test_papers_without_analysis_have_no_row(spark):
    papers = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "paper_id int, analysis string")
    links = spark.createDataFrame([(1, 9, 0), (2, 9, 0)], "paper_id int, author_id int, position int")
    got = R.with_authors(papers, links, spark.createDataFrame([(9, "N")], "author_id int, name string")).collect()
    assert {r["paper_id"]: r["authors"] for r in got} == {1: ["N"], 3: []}


def test_table_store(spark, tmp_path):
    store = D.TableStore(spark, str(tmp_path))
    store.commit("a", spark.range(3))
    store.commit("a", store.read("a").filter("id > 0"))
    assert store.read("a").count() == 2 and store.read("a", 1).count() == 3
    with pytest.raises(ValueError):
        store.read("b")


def test_analysis(spark):
    ok = {f: "x" for f in ("problem_statement", "methodology", "dataset", "key_findings", "limitations", "future_work")} | {"evaluation_metrics": ["a"]}
    cases = [ok, ok | {"dataset": " "}, ok | {"evaluation_metrics": [""]}, ok | {"key_findings": "y" * 20000}, {k: v for k, v in ok.items() if k != "evaluation_metrics"}]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "k int, raw string")
    rows = H.parse_outputs(df, "raw", H.ANALYSIS).select("k", H.analysis_fault(F.col("value"), F.col("raw")).alias("f")).orderBy("k").collect()
    assert [r["f"] for r in rows] == [None, "dataset", "evaluation_metrics", "size", "evaluation_metrics"]


def test_reconcile_of_the_tables_equals_the_whole_loop(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = plans._records(spark, sf)
    want = [(r["topic_id"], r["ordinal"], r["source"], r["title"], r["pdf_url"], r["doi"], len(r["authors"])) for r in whole_loop([r.asDict(True) for r in rows.collect()])]
    got = plans.reconcile_loop(spark, sf).select("topic_id", "ordinal", "source", "title", "pdf_url", "doi", "authors").orderBy("topic_id", "ordinal")
    assert [tuple(r) for r in got.collect()] == want
