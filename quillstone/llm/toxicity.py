"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled texts are a sample of the whole training fold, whose share of
toxic texts is the class prior. A linear classifier is
trained in numpy on the risk ``prior * R+(f) + max(0, R_unlabelled-(f) - prior * R_positive-(f))``: the second part
estimates the risk on negatives and must not fall below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, code_points, fold, letters_or_digits, mix, one_label, slices, strings, table, word_hashes, written

BITS = 20
#: Beginnings of longer words that count as terms beside the words themselves.
PREFIXES = (4, 5, 6, 7, 8)


def term_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each word and of the beginnings of longer words, in groups of bounded size."""
    for at, part in slices([x.lower() for x in texts]):
        codes, owner = code_points(part)
        whole, piece, begun = word_hashes(codes, owner, letters_or_digits(codes), PREFIXES)
        row = np.asarray(at)[piece] if len(piece) else piece
        rows = [row, *(row[longer] for longer, _ in begun)]
        buckets = [mix(whole, 1, BITS), *(mix(own, n, BITS) for n, (_, own) in zip(PREFIXES, begun, strict=True))]
        yield np.concatenate(rows), np.concatenate(buckets)


class Model:
    """Weights of the chosen buckets; a text is the set of its chosen buckets."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.place = np.full(1 << BITS, -1, dtype=np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        keys = [np.empty(0, dtype=np.int64)]
        k = len(self.weights)
        for row, bucket in term_buckets(texts):
            own = self.place[bucket]
            hit = own >= 0
            keys.append(np.unique(row[hit] * k + own[hit]))
        pairs = np.unique(np.concatenate(keys))
        z = np.full(len(texts), self.bias)
        if len(pairs):
            z += np.bincount(pairs // k, weights=self.weights[pairs % k], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 0.03, decay: float = 1e-4, drop: float = 0.4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with logistic loss; when the negative part is below zero its gradient is reversed.

    Terms are dropped at random from the batches, so that one term is enough where texts usually have several.
    """
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        bp, bu = x[rng.choice(p, min(batch, len(p)))], x[rng.choice(u, min(batch, len(u)))]
        bp, bu = bp * (rng.random(bp.shape) >= drop), bu * (rng.random(bu.shape) >= drop)
        zp, zu = bp @ w[:-1] + w[-1], bu @ w[:-1] + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_neg, gu_neg = prior * sp / len(sp), su / len(su)
        if negative >= 0:
            cp, cu = prior * (sp - 1) / len(sp) - gp_neg, gu_neg
        else:
            cp, cu = gp_neg, -gu_neg
        g = np.append(cp @ bp + cu @ bu + decay * w[:-1], cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, positives: int = 4000, unlabelled: int = 8000, features: int = 512, least_z: float = 4.0, least_lift: float = 3.0) -> Model | None:
    """Fit on whole texts of at most ``positives`` toxic documents and ``unlabelled`` documents of any kind of the
    training fold.

    The class prior is the share of toxic rows among the fold's labels. The ``features`` buckets are those whose
    document frequency among the positives exceeds that among the unlabelled most, by ``least_z`` standard errors and
    ``least_lift`` times at least.
    """
    rest = fold(F.col("doc_id"), folds)
    known = one_label(labels, "toxic").filter(rest != held)
    share = known.agg(F.avg((F.col("label") == 1).cast("double")).alias("p"), F.sum((F.col("label") == 1).cast("int")).alias("n")).first()
    if not share["n"] or share["p"] >= 1:
        return None
    toxic = known.filter("label = 1").select("doc_id").withColumn("label", F.lit(1))
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter((rest != held) & F.col("doc_id").isNotNull()).withColumn("label", F.lit(0))
    ids = bounded_ids(toxic, "label", positives).unionByName(bounded_ids(other.distinct(), "label", unlabelled))

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets: list[set] = [set() for _ in range(len(frame))]
            for row, bucket in term_buckets(frame["text"].fillna("").tolist()):
                for key in np.unique((row << BITS) + bucket):
                    sets[key >> BITS].add(int(key & ((1 << BITS) - 1)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "terms": [sorted(s) for s in sets]})

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    sample = written(picked.mapInPandas(terms, "doc_id long, label int, terms array<int>"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    rate = lambda label: (F.sum((F.col("label") == label).cast("int")) + F.lit(0.5)) / F.lit(sizes[label] + 1.0)
    found = sample.select("label", F.explode("terms").alias("t")).groupBy("t").agg(rate(1).alias("p"), rate(0).alias("u"), F.count("*").alias("n")).filter("n >= 3")
    error = F.sqrt(F.col("p") * (1 - F.col("p")) / F.lit(float(sizes[1])) + F.col("u") * (1 - F.col("u")) / F.lit(float(sizes[0])))
    score = (F.col("p") - F.col("u")) / error
    best = found.withColumn("z", score).filter((F.col("z") >= least_z) & (F.col("p") >= least_lift * F.col("u"))).orderBy(F.desc("z"), "t").limit(features)
    buckets = np.sort(np.array([r["t"] for r in best.collect()], dtype=np.int64))
    if not len(buckets):
        return None
    place = {int(b): k for k, b in enumerate(buckets)}

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "terms": [[place[t] for t in own if t in place] for own in frame["terms"]]})

    rows = sample.mapInPandas(chosen, "doc_id long, label int, terms array<int>").toPandas().sort_values("doc_id", kind="stable")
    x = np.zeros((len(rows), len(buckets)), dtype=np.float32)
    for i, own in enumerate(rows["terms"]):
        x[i, np.asarray(own, dtype=np.int64)] = 1
    weights, bias = train_nnpu(x, rows["label"].to_numpy() == 1, float(share["p"]))
    return Model(buckets, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` of every whole text; 0 where there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.scores(strings(batch.column(1))) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(doc_id, held_out, score, predicted)``, one row per input row.

    Empty and null texts get the score of a text without any known word. Null ids are scored and not held out. Repeated
    labels take the larger. Without toxic labels in the training fold every score is 0. Other columns are ignored.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    found = score(docs, fit(docs, labels, folds, held))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
