"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

Subwords are byte runs of 2 to 4 within a word with its borders. The score is the softmax at a temperature fitted on
unseen rows; what scores under a threshold chosen there for a wanted precision is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import labelled_sample, scored, temperature
from .common import joined_bytes

BUCKETS, DIMS = 1 << 16, 16
SEED = 6
UNKNOWN = "und"
#: Bounds of a fit (see classify.labelled_sample); what is taken is learned whole, in stretches of so many characters.
FIT_ROWS, FIT_CHARS = 6_000, 8_000_000
STRETCHES = (40, 160, 600)
#: Stretches that a fit goes through at least, in more epochs if there are few.
STEPS = 40_000
_WORDLIKE = re.compile(r"[^\W\d_]")
#: What is not an ASCII letter or part of a longer character becomes a space.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
ORDERS = (2, 3, 4)
_SALTS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character is a letter: not a digit in a circle, a fraction or a power."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket of the byte run that starts at each place; BUCKETS where it has a space inside."""
    value = data.astype(np.uint32) + np.uint32(1)
    blank = data == 32
    lanes = [value * salt for salt in _SALTS]
    out, code = [], lanes[0]
    for n in range(2, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m < 1:
            break
        code = (code[:m] ^ (code[:m] >> np.uint32(13))) * np.uint32(0x9E3779B1) + lanes[n - 1][n - 1 :]
        inside = blank[:m] & blank[1:] if n == 2 else blank[1 : m + 1] if n == 3 else blank[1 : m + 1] | blank[2 : m + 2]
        bucket = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32)
        bucket[inside] = BUCKETS
        out.append(bucket)
    return out


def folded(texts: list[str | None]) -> list[bytes]:
    return [b" " + (x or "").lower().encode("utf-8", "replace").translate(FOLD) for x in texts]


def _pooled(texts: list[str | None], columns: np.ndarray) -> np.ndarray:
    """For each text the mean over its subwords of columns[:, bucket]; zeros without any."""
    data, starts = joined_bytes(folded(texts))
    total, times = np.zeros((len(texts), len(columns))), np.zeros(len(texts))
    columns = np.concatenate([columns, np.zeros((len(columns), 1), columns.dtype)], axis=1)
    for bucket in subwords(data):
        bucket = np.concatenate([bucket, np.full(len(data) - len(bucket), BUCKETS, bucket.dtype)])
        times += np.add.reduceat((bucket != BUCKETS).astype(np.int32), starts[:-1])
        for k, column in enumerate(columns):
            total[:, k] += np.add.reduceat(column.take(bucket), starts[:-1])
    return total / np.maximum(times, 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def pieces(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """The whole of each text, cut into short, middle and long stretches by turns, so that short texts are learned too."""
    out, y = [], []
    for text, label in zip(texts, labels, strict=True):
        start, turn = 0, int(rng.integers(0, len(STRETCHES)))
        while start < len(text):
            end = start + STRETCHES[turn % len(STRETCHES)]
            if has_letter(piece := text[start:end]):
                out.append(piece)
                y.append(label)
            start, turn = end, turn + 1
    return out, np.array(y, np.int64)


def fit(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 0.5, precision: float = 0.99) -> dict:
    """The model: logits by language and bucket, languages in order, temperature, threshold. One language: always that."""
    names = sorted(set(labels))
    if len(names) < 2:
        return {"names": names}
    rng = np.random.default_rng(SEED)
    y = np.searchsorted(names, labels)
    held = np.arange(len(texts)) % 5 == 0
    parts, target = pieces([t for t, h in zip(texts, held, strict=True) if not h], y[~held], rng)
    bags = []
    for piece in parts:
        data, _ = joined_bytes(folded([piece]))
        bag = np.concatenate(subwords(data))
        bags.append(bag[bag != BUCKETS])
    rows = rng.uniform(-1, 1, (BUCKETS, DIMS)) / DIMS
    top = np.zeros((DIMS, len(names)))
    epochs = max(epochs, -(-STEPS // max(1, len(bags))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for start in range(0, len(order), 32):
            some = order[start : start + 32]
            sizes = np.array([len(bags[i]) for i in some])
            bucket = np.concatenate([bags[i] for i in some])
            mean = np.add.reduceat(rows[bucket], np.cumsum(sizes) - sizes) / sizes[:, None]
            error = _softmax(mean @ top)
            error[np.arange(len(some)), target[some]] -= 1
            back = error @ top.T / sizes[:, None] * step
            top -= step * mean.T @ error / 4
            places, inverse = np.unique(bucket, return_inverse=True)
            owner = np.repeat(np.arange(len(some)), sizes)
            for d in range(DIMS):
                rows[places, d] -= np.bincount(inverse, back[owner, d], len(places))
    table = np.ascontiguousarray((rows @ top).T, np.float32)
    unseen, truth = pieces(whole := [t for t, h in zip(texts, held, strict=True) if h], y[held], rng)
    unseen, truth = unseen + whole, np.concatenate([truth, y[held]])
    logits = _pooled(unseen, table)
    t = temperature(logits, truth)
    p = _softmax(logits / t)
    right, best = p.argmax(1) == truth, p.max(1)
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    return {"names": names, "table": table, "t": t, "threshold": float(best[order[good[-1]]]) if len(good) else 1.0}


def scorer(model: dict) -> Callable[[list[str | None]], dict]:
    names = np.array([*model["names"], UNKNOWN], object)

    def score(texts: list[str | None]) -> dict:
        lettered = np.array([bool(x) and has_letter(x) for x in texts])
        if "table" in model:
            p = _softmax(_pooled(texts, model["table"]) / model["t"])
            best, top = p.argmax(1), p.max(1)
        else:
            best, top = np.zeros(len(texts), int), np.full(len(texts), float(bool(model["names"])))
        best = np.where(lettered, best, len(names) - 1)
        top = np.where(lettered, top, 0.0)
        return {"best_lang": names[best].tolist(), "score": top, "accepted": lettered & (top >= model.get("threshold", 0.0))}

    return score


def languages(docs: DataFrame, training: DataFrame, label: str = "lang") -> DataFrame:
    """doc_id, best_lang, score, accepted, lang (best_lang if accepted, else `und`) of each row of docs.

    best_lang is `und` and the score 0 where the text is null or has no letter. training has doc_id, text and label; of
    it a bounded sample is fitted. Other columns are ignored; repeated rows stay; an empty docs gives no rows.
    """
    model = fit(*labelled_sample(training, label, FIT_ROWS, FIT_CHARS))
    out = scored(docs, lambda: scorer(model), "best_lang string, score double, accepted boolean")
    return out.withColumn("lang", F.when(F.col("accepted"), F.col("best_lang")).otherwise(UNKNOWN))
