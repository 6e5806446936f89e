"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

A word's vector is the sum of the sparse ternary index vectors of its neighbours in the training texts. A document is
the mean vector of its words and marks. The network's logit is divided by a temperature fitted on rows it hasn't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .classify import labelled_sample, scored, sigmoid, temperature

BUCKETS, DIMS, HIDDEN = 1 << 15, 48, 32
SEED = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
MEMO = 50_000
#: Rows of marks beside the buckets of words: a word like the one before it, a word in capitals, an empty text.
REPEAT, UPPER, EMPTY = BUCKETS, BUCKETS + 1, BUCKETS + 2


def _bucket(token: str) -> int:
    return crc32(token.encode("utf-8", "replace")) & (BUCKETS - 1)


def index_vectors(rows: int = BUCKETS + 3, dims: int = DIMS, entries: int = 8) -> np.ndarray:
    """Sparse ternary rows: half of the entries 1, half -1, at places dealt by the seed."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((rows, dims), np.float32)
    at = np.argsort(rng.random((rows, dims)), axis=1)[:, :entries]
    np.put_along_axis(out, at, np.tile([1.0, -1.0], entries // 2).astype(np.float32)[None, :], axis=1)
    return out


class Pooler:
    """Texts to mean vectors. Whole texts; the memo of tokens is bounded."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.memo = vectors, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        memo = self.memo
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text or "")
            if not tokens:
                out[i] = self.vectors[EMPTY]
                continue
            counts = Counter(tokens)
            if len(memo) > MEMO:
                memo.clear()
            for token in [x for x in counts if x not in memo]:
                memo[token] = _bucket(token)
            where = [memo[x] for x in counts]
            times = list(counts.values())
            where += [REPEAT, UPPER]
            times += [sum(map(eq, tokens, tokens[1:])), sum(n for x, n in counts.items() if len(x) > 1 and x.isupper())]
            out[i] = np.array(times, np.float32) @ self.vectors[where] / len(tokens)
        return out


def word_vectors(texts: list[str]) -> np.ndarray:
    """Sums of the index vectors of both neighbours, of unit length; rows never seen keep their index vector."""
    index = index_vectors()
    seen = np.array([b for x in texts for b in (*map(_bucket, TOKEN.findall(x)), EMPTY)], np.int64)
    total, times = np.zeros_like(index), np.bincount(seen, minlength=len(index))
    for d in range(index.shape[1]):
        near = np.zeros(len(seen), np.float32)
        near[1:] += index[seen[:-1], d]
        near[:-1] += index[seen[1:], d]
        total[:, d] = np.bincount(seen, near, len(index))
    total[EMPTY], times[EMPTY] = index[EMPTY], 1
    total = np.where(times[:, None] > 0, total, index) + 0.5 * index  # of its own a part, so that words of like company differ
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> tuple:
    """Adam on the logistic loss of one hidden rectified layer. Returns the weights."""
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            rows = order[start : start + batch]
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            error = (sigmoid(hidden @ weights[2] + weights[3]) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (hidden > 0)
            grads = [x[rows].T @ back + decay * weights[0], back.sum(0), hidden.T @ error + decay * weights[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def fit(texts: list[str], labels: list[int]) -> dict:
    """The model. A sample without both labels gives a constant score: its (smoothed) share of label 1."""
    y = np.array(labels, np.float64)
    base = float((y.sum() + 1) / (len(y) + 2))
    if len(set(labels)) < 2:
        return {"base": base}
    held = np.arange(len(texts)) % 5 == 0
    vectors = word_vectors([t for t, h in zip(texts, held, strict=True) if not h])
    x = Pooler(vectors)(texts)
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    x = (x - mean) / scale
    weights = train_network(x[~held], y[~held])
    logit = np.maximum(x[held] @ weights[0] + weights[1], 0) @ weights[2] + weights[3]
    return {"base": base, "vectors": vectors, "mean": mean, "scale": scale, "weights": weights, "t": temperature(np.c_[np.zeros(len(logit)), logit], y[held].astype(int))}


def scorer(model: dict) -> Callable[[list[str | None]], dict]:
    if "vectors" not in model:
        return lambda texts: {"score": np.full(len(texts), model["base"])}
    pool = Pooler(model["vectors"])

    def score(texts: list[str | None]) -> dict:
        x = (pool(texts) - model["mean"]) / model["scale"]
        logit = np.maximum(x @ model["weights"][0] + model["weights"][1], 0) @ model["weights"][2] + model["weights"][3]
        return {"score": sigmoid(logit / model["t"]).astype(np.float64)}

    return score


def quality_scores(docs: DataFrame, training: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs, null and empty texts too.

    training has doc_id, label (1: good) and, if its texts aren't those of docs, text; of it a bounded sample is fitted (see classify). Rows of null doc_id are scored but teach nothing. Other columns of
    either are ignored; repeated rows are scored as often as they stand; an empty docs gives no rows.
    """
    model = fit(*labelled_sample(training, label, texts=None if "text" in training.columns else docs))
    return scored(docs, lambda: scorer(model), "score double")
