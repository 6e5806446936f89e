"""What the trained classifiers share: bounded labelled samples, folds, calibration, the scoring pass."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Bounds of a fit: labelled rows, and characters of their texts, taken in hash order. Scores cover every row.
FIT_ROWS = 8_000
FIT_CHARS = 24_000_000
#: Times rows_most labels that are looked up at most.
TRIES = 16


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def labelled_sample(rows: DataFrame, label: str, rows_most: int = FIT_ROWS, chars_most: int = FIT_CHARS, texts: DataFrame | None = None) -> tuple[list[str], list]:
    """Texts and labels of at most rows_most rows, in hash order of doc_id, up to the first that would pass chars_most characters.

    rows has doc_id, the label and, unless texts (doc_id, text) is given, text. With texts the sample is chosen from the
    labels alone: rows_most ids, or TRIES times as many if too few of those have a text, are broadcast to a scan of the
    texts, which are not shuffled. Null doc_ids, texts and labels teach nothing; an id with several labels has its least.
    The first row is taken whatever its length. Equal inputs give equal samples.
    """
    spark, order, found = rows.sparkSession, F.xxhash64("doc_id"), {}
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    named = lambda ids: F.broadcast(spark.createDataFrame([(x,) for x in ids], "doc_id long"))
    long = lambda df: df.where(F.col("text").isNotNull()).select("doc_id", order.alias("_h"), F.length("text").alias("_n")).orderBy("_h", "doc_id", "_n").limit(rows_most).collect()
    if texts is None:
        texts = rows
        light = long(rows)
    else:
        texts = texts.where(F.col("doc_id").isNotNull())
        for most in (rows_most, TRIES * rows_most):
            some = rows.select("doc_id", label).orderBy(order, "doc_id", label).limit(most).collect()
            found = {}
            for x, y in some:
                found.setdefault(x, y)
            light = long(texts.join(named(found), "doc_id", "left_semi")) if found else []
            if len(some) < most or len(light) >= rows_most:
                break
    kept, total = [], 0
    for row in light:
        if total and total + row["_n"] > chars_most:
            break
        kept.append((row["doc_id"], row["_n"]))
        total += row["_n"]
    if not kept:
        return [], []
    sizes = spark.createDataFrame(sorted(set(kept)), "doc_id long, _n int")  # a shared id may have longer texts too
    texts = texts.where(F.col("text").isNotNull()).select("doc_id", "text", *([] if found else [label]), F.length("text").alias("_n"))
    got = texts.join(F.broadcast(sizes), ["doc_id", "_n"], "left_semi").drop("_n").toPandas()
    got["_h"] = [zlib.crc32(str(x).encode()) for x in got["doc_id"]]
    got = got.sort_values(["_h", "doc_id", "text"], kind="stable").head(rows_most)
    return got["text"].tolist(), [found[x] for x in got["doc_id"]] if found else got[label].tolist()


def scored(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], fields: str) -> DataFrame:
    """doc_id and what make()(texts) returns for each text (null: empty), in one pass without a shuffle. make() runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for part in (x for batch in batches for x in slices(batch)):
            got = score(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in got.values())], ["doc_id", *got])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, f"doc_id long, {fields}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least negative log-likelihood; logits (n, classes), target class numbers."""
    if not len(target):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(target)), target]))

    return min(np.geomspace(0.25, 8, 60), key=loss)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit of y on score (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1, s, s])
        if len(blocks) > 1 and blocks[-2][3] == s:  # ties are one point
            v2, n2, _, _ = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + v2 * n2) / (a[1] + n2), a[1] + n2, a[2], s]
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    x = np.array([e for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    p = np.array([b[0] for b in blocks for _ in range(1 + (b[3] > b[2]))])
    return x, p
