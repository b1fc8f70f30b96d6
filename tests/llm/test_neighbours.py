"""Quality by nearest neighbours against a plain vote over all cosines."""

import numpy as np
from quillstone.llm import quality_knn as Q

from .test_operators import SF, needs_tables


def plain_score(model, text):
    counts = np.zeros(1 << Q.BITS)
    for _, part in Q.features([text]):
        counts += part.sum(axis=0)
    x = np.log1p(counts) * model.idf.astype(np.float64)
    z = np.array([float(np.dot(x, axis)) for axis in model.axes.T.astype(np.float64)])
    z /= max(float(np.sqrt((z * z).sum())), 1e-9)
    votes = sorted(((float(np.dot(z, v)), float(label)) for v, label in zip(model.vectors.astype(np.float64), model.labels, strict=True)), key=lambda p: -p[0])
    weights = [max(c, 0.0) ** 4 + 1e-9 for c, _ in votes[: model.k]]
    return sum(w * label for w, (_, label) in zip(weights, votes, strict=False)) / sum(weights), votes[model.k - 1][0] - votes[model.k][0]


@needs_tables
def test_votes_against_all_cosines(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, 5, 0)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(150).collect()] + ["x" * 3, "a b " * 300_000]
    got = model.scores(texts, block=7)
    assert np.allclose(got, model.scores(texts, block=512), atol=1e-6)
    assert np.allclose(got[:20], [model.scores([t])[0] for t in texts[:20]], atol=1e-6)  # whatever texts are scored with it
    close = 0
    for text, score in zip(texts, got, strict=True):
        want, gap = plain_score(model, text)
        if gap > 1e-5:  # not where the last voter is a tie in single precision
            assert abs(score - want) < 1e-5, text[:60]
            close += 1
    assert close > 100
    by_id = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    own = {r["doc_id"]: s for r, s in zip(docs.orderBy("doc_id").limit(150).collect(), got, strict=False)}
    assert all(abs(by_id[k] - s) < 1e-6 for k, s in own.items())
