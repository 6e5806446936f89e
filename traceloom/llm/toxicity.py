"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon (given words, and words and word beginnings that the training rows single out), how near
its hits stand to second-person words, capitals, punctuation and obfuscation rates. The lexicon is learned on one part of
the training sample, the trees on a second, the calibration on a third.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .classify import isotonic, labelled_sample, scored, sigmoid
from .common import in_arrow, slices

#: Common insults to start from, words of the second person in four languages, characters that stand for letters.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting ugly fool clown jerk hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted ustedes tus vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
VEIL = re.compile(r"[0-9@$!*]+(?=[^\W\d_])")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-*][^\W\d_]){3,}(?![^\W_])")
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
NEAR = 6
PREFIXES = (5, 6, 7)
MEMO = 50_000
FEATURES = 13


def _units(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def _around(text: str, at: int) -> str:
    """What stands between the spaces around a place."""
    end = text.find(" ", at)
    return text[text.rfind(" ", 0, at) + 1 : end if end >= 0 else len(text)]


def learn_lexicon(texts: list[str], labels: list[int], least: int = 3, strong: float = 2.0) -> dict[str, float]:
    """Units (words, beginnings of words) by log odds ratio of the documents that have them, as far as it is strong."""
    counts = [Counter(), Counter()]
    sizes = [labels.count(0) + 1, labels.count(1) + 1]
    for text, label in zip(texts, labels, strict=True):
        counts[label].update({u for w in set(WORD.findall(text.lower())) for u in _units(w)})
    out = dict.fromkeys(INSULTS, strong)
    for unit, n in counts[1].items():
        value = np.log((n + 0.5) / sizes[1]) - np.log((counts[0][unit] + 0.5) / sizes[0])
        if n >= least and value >= strong:
            out[unit] = float(value)
    return out


class Features:
    """Texts to rows of FEATURES numbers. Whole texts; empty ones give zeros."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def value(self, word: str) -> float:
        return max(self.lexicon.get(u, 0.0) for u in _units(word))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES), np.float32)
        for i, text in enumerate(texts):
            if text:
                out[i] = self._row(text)
        return out

    def _row(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        counts, memo = Counter(words), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for word in [x for x in counts if x not in memo]:
            memo[word] = self.value(word)
        hits = {w: memo[w] for w in counts if memo[w]}
        n = max(len(words), 1)
        times = sum(counts[w] for w in hits)
        worst = sorted(hits.values(), reverse=True)[:3]
        near = 0
        if hits:
            second = [k for k, w in enumerate(words) if w in SECOND_PERSON]
            if second:
                at = np.searchsorted(second, places := [k for k, w in enumerate(words) if w in hits])
                near = sum(min((abs(second[b] - p) for b in (a - 1, a) if 0 <= b < len(second)), default=NEAR + 1) <= NEAR for a, p in zip(at, places, strict=True))
        data = text.encode("utf-8", "replace")
        disguised = {_around(text, m.start()) for m in VEIL.finditer(text) if m.start() and text[m.start() - 1].isalpha()}
        spaced = SPACED.findall(text)
        veiled = sum(self.value(w.lower().translate(LEET).replace("*", "")) > 0 for w in disguised)
        veiled += sum(self.value(re.sub(r"[^\w]", "", w.lower())) > 0 for w in spaced)
        return [
            times / n, np.log1p(times), len(hits), sum(worst), worst[0] if worst else 0.0, sum(hits[w] * counts[w] for w in hits) / n,
            near / n, np.log1p(near), 1 - len(data.translate(None, UPPER)) / len(data), 1 - len(data.translate(None, MARKS)) / len(data),
            len(disguised) / n, veiled, np.log1p(n),
        ]


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, bins: int, least: float = 8.0, ridge: float = 1.0) -> tuple | float:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(-g / (h + ridge))
    if not depth or len(rows) < 2 * least:
        return leaf
    best = (1e-6, 0, 0)
    for f in range(codes.shape[1]):
        gs = np.cumsum(np.bincount(codes[rows, f], grad[rows], bins))[:-1]
        hs = np.cumsum(np.bincount(codes[rows, f], hess[rows], bins))[:-1]
        ns = np.cumsum(np.bincount(codes[rows, f], minlength=bins))[:-1]
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        if gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    if not best[0] > 1e-6:
        return leaf
    left = codes[rows, best[1]] <= best[2]
    return best[1], best[2], _grow(codes, grad, hess, rows[left], depth - 1, bins), _grow(codes, grad, hess, rows[~left], depth - 1, bins)


def _leaves(tree: tuple | float, codes: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(codes), tree)
    left = codes[:, tree[0]] <= tree[1]
    return np.where(left, _leaves(tree[2], codes), _leaves(tree[3], codes))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, depth: int = 3, bins: int = 64) -> dict:
    """Histogram gradient boosting of the logistic loss by Newton steps."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    codes = _codes(cuts, x)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = sigmoid(total)
        tree = _grow(codes, p - y, p * (1 - p), np.arange(len(y)), depth, bins)
        trees.append(tree)
        total = total + rate * _leaves(tree, codes)
    return {"cuts": cuts, "base": base, "rate": rate, "trees": trees}


def _codes(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    codes = _codes(model["cuts"], x)
    return model["base"] + model["rate"] * sum((_leaves(t, codes) for t in model["trees"]), np.zeros(len(x)))


def fit(texts: list[str], labels: list[int]) -> dict:
    """The model. A sample in which a part lacks one of the labels gives a constant score: its (smoothed) share of label 1."""
    part = np.arange(len(texts)) % 20
    parts = [np.flatnonzero(m) for m in (part < 9, (part >= 9) & (part < 15), part >= 15)]
    base = (labels.count(1) + 1) / (len(labels) + 2)
    if any(len({labels[i] for i in rows}) < 2 for rows in parts):
        return {"share": base}
    # copies of a text in another part would show the trees their own labels
    seen = {texts[i] for i in parts[0]}
    parts[1:] = [np.array([i for i in rows if texts[i] not in seen], int) for rows in parts[1:]]
    features = Features(learn_lexicon([texts[i] for i in parts[0]], [labels[i] for i in parts[0]]))
    x = [features([texts[i] for i in rows]) for rows in parts[1:]]
    y = [np.array([labels[i] for i in rows], float) for rows in parts[1:]]
    if any(len(set(v.tolist())) < 2 for v in y):
        return {"share": base}
    trees = boost(x[0], y[0])
    return {"lexicon": features.lexicon, "trees": trees, "knots": isotonic(margin(trees, x[1]), y[1])}


def scorer(model: dict) -> Callable[[list[str | None]], dict]:
    if "share" in model:
        return lambda texts: {"score": np.full(len(texts), model["share"])}
    features = Features(model["lexicon"])

    def score(texts: list[str | None]) -> dict:
        m = margin(model["trees"], features(texts))
        p = np.interp(m, *model["knots"])
        # a trace of the margin keeps the order within a step of the calibration
        return {"score": np.clip(0.98 * p + 0.02 * sigmoid(m), 0, 1)}

    return score


def toxicity_scores(docs: DataFrame, training: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs, null and empty texts too.

    training has doc_id, label (1: toxic) and, if its texts aren't those of docs, text; of it a bounded sample is fitted (see classify). Rows of null doc_id are scored but teach nothing. Other columns of
    either are ignored; repeated rows are scored as often as they stand; an empty docs gives no rows.
    """
    model = fit(*labelled_sample(training, label, texts=None if "text" in training.columns else docs))
    return scored(docs, lambda: scorer(model), "score double")


def without_toxic(docs: DataFrame, training: DataFrame, cut: float, label: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, that score under cut; as toxicity_scores else. One pass, no shuffle."""
    model = fit(*labelled_sample(training, label, texts=None if "text" in training.columns else docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for part in (x for batch in batches for x in slices(batch)):
            got = score(part.column(part.schema.get_field_index("text")).to_pylist())["score"]
            yield part.filter(pa.array(got < cut))

    return docs.transform(in_arrow, run, docs.schema)
