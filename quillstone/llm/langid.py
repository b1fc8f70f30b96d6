"""Operator 10: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, code_points, fold, mix, slices, strings, table, written

ORDERS = (1, 2, 3)
BITS = 15
_LETTER = regex.compile(r"\p{L}")


def gram_buckets(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, piece) of the n-grams of every order. White space counts as one sign and stands only at a gram's ends."""
    c = codes.astype(np.uint64)
    gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
    c[gap] = 32
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = c[:m].copy()
        for k in range(1, n):
            h = h * np.uint64(0x110003) + c[k : k + m]
        ok = ~gap[:m] if n == 1 else ~(gap[:m] & gap[n - 1 : n - 1 + m])
        for k in range(1, n - 1):
            ok &= ~gap[k : k + m]
        where = np.flatnonzero(ok)
        yield mix(h[where], n, BITS), owner[where]


def _lower(texts: list[str]) -> list[str]:
    return [x.lower() for x in texts]


#: Languages in one block of the matrix of log probabilities (32 MB a block), which are broadcast one by one.
BLOCK = 256
#: Up to this many languages a training task sums its counts in a dense matrix; beyond, it hands them on slice by slice.
DENSE = 64


def score(prior: np.ndarray, blocks: list[np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its posterior probability for each text, over the columns of all ``blocks``."""
    total = np.tile(prior, (len(texts), 1))
    for at, part in slices(_lower(texts)):
        codes, owner = code_points(part)
        for bucket, piece in gram_buckets(codes, owner):
            if not len(bucket):
                continue
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            rows = np.asarray(at)[piece[first]]
            for k, column in enumerate(c for x in blocks for c in x.T):
                np.add.at(total[:, k], rows, np.add.reduceat(column[bucket], first, dtype=np.float64))
    best = total.argmax(axis=1)
    return best, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


class Model:
    """Log probabilities of every bucket under each language, in blocks of languages, and the log priors."""

    def __init__(self, names: list[str], counts: np.ndarray | Iterable[np.ndarray], documents: np.ndarray, smoothing: float = 0.5) -> None:
        self.names = names
        whole = [counts[:, k : k + BLOCK] for k in range(0, len(names), BLOCK)] if isinstance(counts, np.ndarray) else counts
        self.blocks = [np.log((c + smoothing) / (c + smoothing).sum(axis=0, keepdims=True)).astype(np.float32) for c in whole]
        self.prior = np.log(documents / documents.sum())

    @property
    def log_p(self) -> np.ndarray:
        return np.concatenate(self.blocks, axis=1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return score(self.prior, self.blocks, texts)


def fit(docs: DataFrame, train: DataFrame, per_language: int = 3000) -> Model | None:
    """Learn from ``train(doc_id, label)``: whole texts of at most ``per_language`` documents of every label (a documented
    bound of the fit; scoring covers every row). The driver and each worker hold 128 KB a label."""
    names = sorted(r["label"] for r in train.select("label").distinct().collect())
    if not names:
        return None
    ids = bounded_ids(train, "label", per_language)
    place = {x: k for k, x in enumerate(names)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = len(names) <= DENSE
        total = np.zeros((len(names) if dense else 0, 1 << BITS), dtype=np.int64)
        seen = np.zeros(len(names), dtype=np.int64)
        for frame in frames:
            label = frame["label"].map(place).to_numpy()
            np.add.at(seen, label, 1)
            for at, part in slices(_lower(frame["text"].fillna("").tolist())):
                codes, owner = code_points(part)
                own = label[np.asarray(at)]
                for bucket, piece in gram_buckets(codes, owner):
                    place_of = (own[piece] << BITS) + bucket
                    if dense:
                        total += np.bincount(place_of, minlength=len(names) << BITS).reshape(total.shape)
                        continue
                    found, n = np.unique(place_of, return_counts=True)
                    yield pd.DataFrame({"label": found >> BITS, "bucket": found & ((1 << BITS) - 1), "n": n})
        k, b = np.nonzero(total)
        yield pd.DataFrame({"label": np.concatenate([k, np.arange(len(names))]), "bucket": np.concatenate([b, np.full(len(names), -1)]), "n": np.concatenate([total[k, b], seen])})

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")
    rows = picked.mapInPandas(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    documents = np.zeros(len(names))
    own = rows["bucket"] >= 0
    documents[rows["label"][~own]] = rows["n"][~own]
    label, bucket, n = (rows.loc[own, c].to_numpy() for c in ("label", "bucket", "n"))

    def blocks() -> Iterator[np.ndarray]:
        for k in range(0, len(names), BLOCK):
            here = (label >= k) & (label < k + BLOCK)
            counts = np.zeros((1 << BITS, min(BLOCK, len(names) - k)))
            counts[bucket[here], label[here] - k] = n[here]
            yield counts

    return Model(names, blocks(), np.maximum(documents, 1))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)``; ``und`` with score 0 for a text that is null or has no letter, or without a model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.names, model.prior) if model else None)
    parts = [spark.sparkContext.broadcast(x) for x in (model.blocks if model else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, prior = shared.value or ([], None)
        blocks = [x.value for x in parts]
        step = max(1, (1 << 22) // max(1, len(names_of)))
        for batch in batches:
            texts = strings(batch.column(1))
            known = np.array([bool(names_of) and _LETTER.search(x) is not None for x in texts], dtype=bool)
            names, sure = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for k in range(0, len(texts) if names_of else 0, step):
                best, p = score(prior, blocks, texts[k : k + step])
                here = known[k : k + step]
                names[k : k + step][here], sure[k : k + step][here] = np.array(names_of, dtype=object)[best[here]], p[here]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = 3000) -> DataFrame:
    """``docs(doc_id, text, lang, …)`` -> ``(doc_id, held_out, lang_pred, score)``, one row per input row.

    Learns from rows with a language whose crc32 fold is not ``held``. Null ids are scored, not learned from, and count
    as not held out. Without any language to learn, and for an empty table, nothing fails: predictions are ``und``.
    """
    rest = fold(F.col("doc_id"), folds)
    train = docs.filter((rest != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.max("lang").alias("label"))
    model = fit(docs, train, per_language)
    return predict(docs, model).select("doc_id", F.coalesce(rest == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
