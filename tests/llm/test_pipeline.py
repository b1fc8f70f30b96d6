"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import os

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from quillstone.llm.decontaminate import OP5_SQL, decontaminated
from quillstone.llm.line_dedup import clean_documents
from quillstone.llm.quality_rules import OP6_SQL
from quillstone.scratch import written

from .test_operators import brute_groups, none, odd  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_sql(docs, sql, query):
    """doc_ids of a query over an operator's SQL, on these documents."""
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    return {doc_id for (doc_id,) in con.sql(query.replace("%s", sql)).fetchall()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = seen["quality_rules"]
    assert {r["doc_id"] for r in after.collect()} == by_sql(before, OP6_SQL, "SELECT doc_id FROM (%s) WHERE kept")
    before, after = seen["near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == {rows[g]["doc_id"] for g in brute_groups([r["text"] for r in rows])}
    before, after = seen["decontamination"]
    gone = by_sql(before, OP5_SQL, "SELECT doc_id FROM (%s)")
    assert gone and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - gone
    before, after = seen["packing"]
    packed = after.collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}
    sizes = np.bincount(np.unique([r["sequence_id"] for r in packed], return_inverse=True)[1], weights=[r["length"] for r in packed])
    assert sizes.max() <= 2048
    again = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df)
    assert key(again.collect()) == key(packed)


def test_stages_on_odd_rows(spark, odd, none):  # noqa: F811
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing column names, no rows."""
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, SF), name)
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= docs.count()
                assert out.exceptAll(docs).count() == 0  # no value of a row has changed
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, odd, SF).collect()} == {r["doc_id"] for r in odd.collect()}


def test_rows_are_decontaminated_by_text(spark):
    item = "the tide gauge at the outer mole has been read twice a day since the winter of the great flood"
    rows = [(1, "clean words of another page"), (1, f"before {item} after"), (None, item), (None, "clean"), (None, None), (2, ""), (3, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _row", "3 AS item_id")
    left = decontaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([rows[0], *rows[3:6]], key=repr)


def test_line_dedup_keeps_columns_named_like_its_counts(spark):
    rows = [(k, f"line {k}\nHome | About", "s", 9, 777, 888) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_lines long, n_dropped long")
    got = clean_documents(docs).collect()
    assert {(r["text"], r["n_lines"], r["n_dropped"]) for r in got} == {(f"line {k}", 777, 888) for k in range(20)}
