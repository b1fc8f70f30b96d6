"""Operator 4: document quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled texts is projected by a truncated SVD of its tf-idf matrix and broadcast. Every document
is projected the same way, its cosines with all labelled vectors are computed exactly in blocks, and the nearest
neighbours vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, code_points, fold, mix, one_label, slices, strings, table, word_hashes

BITS = 12
#: Classes of signs: other, lower case, upper case, digit, white space, then each ASCII sign for itself.
_CLASS = np.zeros(128, dtype=np.uint64)
for _c in range(33, 127):
    _CLASS[_c] = _c
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9:14] = 1, 2, 3, 4, 5
SHAPE = 3


def features(texts: list[str], rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, dense counts of hashed terms) for groups of texts.

    Terms: words without ASCII white space, three-sign shapes, and repeats of the word before.
    """
    size = 1 << BITS
    for at, part in slices(texts, rows=rows):
        codes, owner = code_points(part)
        gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
        word, piece, _ = word_hashes(codes, owner, ~gap)
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (piece[1:] == piece[:-1])
        kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint64(1))
        shape = kind[:-2] << np.uint64(16) | kind[1:-1] << np.uint64(8) | kind[2:]
        own = owner[1:-1] == owner[2:]  # but not around the space behind a text, where the next one begins
        keys = [piece * size + mix(word, 3, BITS), owner[1:-1][own] * size + mix(shape[own], 4, BITS), piece[same] * size + 7]
        yield np.asarray(at), np.bincount(np.concatenate(keys), minlength=len(part) * size).reshape(len(part), size)


def dense(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Like features(), with the pieces of a very long text added up."""
    held_at: int | None = None
    held: np.ndarray | None = None
    for at, counts in features(texts):
        rows, first = np.unique(at, return_index=True)
        counts = np.add.reduceat(counts, first, axis=0) if len(rows) < len(at) else counts
        if held is not None and rows[0] == held_at:
            counts[0] += held
        elif held is not None:
            yield np.array([held_at]), held[None]
        held_at, held = int(rows[-1]), counts[-1].copy()
        if len(rows) > 1:
            yield rows[:-1], counts[:-1]
    if held is not None:
        yield np.array([held_at]), held[None]


class Model:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int, prior: float) -> None:
        self.idf, self.axes, self.vectors, self.labels, self.k, self.prior = idf, axes, vectors, labels, min(neighbours, len(labels)), prior

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str], block: int = 512) -> np.ndarray:
        z = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        empty = np.ones(len(texts), dtype=bool)
        for rows, counts in dense(texts):
            z[rows] = self.project(counts)
            empty[rows] = False
        out = np.empty(len(texts))
        for i in range(0, len(texts), block):
            cosine = z[i : i + block] @ self.vectors.T
            near = np.argpartition(-cosine, self.k - 1, axis=1)[:, : self.k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4 + 1e-9
            out[i : i + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        blank = np.array([not x.strip() for x in texts], dtype=bool)
        out[blank | empty] = self.prior
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_label: int = 1500, dimensions: int = 64, neighbours: int = 15) -> Model | None:
    """At most ``per_label`` whole texts of each label make the space and the voters; every document is scored."""
    known = one_label(labels, "quality").filter(fold(F.col("doc_id"), folds) != held)
    ids = bounded_ids(known, "label", per_label)

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, counts in dense(frame["text"].fillna("").tolist()):
                own = [np.flatnonzero(c) for c in counts]
                part = frame.iloc[rows]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(), "i": [x.tolist() for x in own], "n": [c[x].tolist() for c, x in zip(counts, own, strict=True)]})

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long"), "text", "label")
    rows = picked.mapInPandas(sparse, "doc_id long, label int, i array<int>, n array<int>").toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return None
    x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for k, (i, n) in enumerate(zip(rows["i"], rows["n"], strict=True)):
        x[k, np.asarray(i, dtype=np.int64)] = np.log1p(np.asarray(n, dtype=np.float32))
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
    x *= idf
    rng, width = np.random.default_rng(5), min(dimensions + 16, len(x), x.shape[1])
    y = x @ rng.standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T.copy()
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    label = rows["label"].to_numpy(dtype=np.float64)
    return Model(idf, axes, z, label, neighbours, float(label.mean()))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` of every whole text; 0.5 where there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.scores(strings(batch.column(1))) if m and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(doc_id, held_out, score, predicted)``, one row per input row.

    Empty and null texts get the share of good labels among the voters. Null ids are scored and not held out. Repeated
    labels take the larger. Without labels in the training fold every score is 0.5. Other columns are ignored.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    found = score(docs, fit(docs, labels, folds, held))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
