"""Quality classifier: a support vector machine over naive-Bayes-scaled n-gram indicators.

The n-grams are words, and runs of one to three word shapes (letters, case, digits and signs) with a mark where a word
repeats the one before it. Each indicator is scaled by its log-count ratio between the classes; a linear hinge-loss
model is fitted by dual coordinate descent on a bounded sample, and its margin is turned into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import MEMO_ENTRIES, MEMO_ENTRY_BYTES, memo, slices, texts
from gridframe.llm.labelled import logistic, prior_shift, training_sample

#: Labelled documents of each class that the fit takes at most.
SAMPLE_PER_CLASS = 2000
BITS = 18


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits shrink to A, a and 0; other signs stay, runs of one sign as two."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
        elif k not in "Aa0" and (len(out) < 2 or out[-2] != k):
            out.append(k)
    return "".join(out)


class _Words(dict):
    """A word's two hashes: of its lower case and of its shape."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word))
        if len(word) <= MEMO_ENTRY_BYTES // 4:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value


_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and features, each pair once, ordered by row."""
    known, words = memo("quality", _Words), [x.split() for x in docs]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    both = np.fromiter((known[w] for doc in words for w in doc), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(docs)), sizes)
    lower, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(both), np.uint64)
    inside = row[1:] == row[:-1]
    again[1:][(both[1:] == both[:-1]) & inside] = 1
    form = form * np.uint64(2) + again
    found = [(row, lower * _SALTS[0]), (row, form * _SALTS[1])]
    pair = form[1:] * _SALTS[1] + form[:-1] * _SALTS[2] + np.uint64(1)
    found.append((row[1:][inside], pair[inside]))
    three = inside[1:] & inside[:-1]
    found.append((row[2:][three], (pair[1:] + form[:-2] * _SALTS[0] + np.uint64(2))[three]))
    keys = np.unique(np.concatenate([(r << BITS) | _mixed(h) for r, h in found]))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def margins(docs: list[str], weights: np.ndarray) -> np.ndarray:
    """Without the intercept; a document's scaled indicators have length one, and none at all give 0."""
    row, feature = indicators(docs)
    n = np.bincount(row, minlength=len(docs))
    return np.bincount(row, weights[feature], len(docs)) / np.sqrt(np.maximum(n, 1))


def fit_svm(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights with the log-count ratios folded in, and the intercept. ``rows``: features of each document; y: 0 or 1."""
    count = [np.full(1 << BITS, 1.0) for _ in range(2)]
    for features, label in zip(rows, y, strict=True):
        count[label][features] += 1
    ratio = np.log(count[1] / ((y == 1).sum() + 2)) - np.log(count[0] / ((y == 0).sum() + 2))
    values = [ratio[f] / np.sqrt(max(1, len(f))) for f in rows]
    sign = 2.0 * y - 1
    share = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum())) * cost
    norm = np.array([v @ v + 1.0 for v in values])
    w, b, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in random.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = sign[i] * (w[f] @ v + b) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), share[i])
            if (change := (new - dual[i]) * sign[i]) != 0:
                w[f] += change * v
                b += change
                dual[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w * ratio, b


def fit_model(rows: list[np.ndarray], y: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, float, float]:
    """Weights, and the slope and intercept that turn a margin into log-odds; these come from documents left out of a fit."""
    total = sizes.get(0, 0) + sizes.get(1, 0)
    if min((y == 0).sum(), (y == 1).sum()) < 2:  # nothing to tell apart: everyone gets the smoothed share of label 1
        p = (sizes.get(1, 0) + 1) / (total + 2)
        return np.zeros(1 << BITS, np.float32), 0.0, float(np.log(p / (1 - p)))
    margin = lambda w, f: w[f].sum() / np.sqrt(max(1, len(f)))
    out, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        w, b = fit_svm([r for r, x in zip(rows, fold, strict=True) if x != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            out[i] = margin(w, rows[i]) + b
    a, c = logistic(out[:, None], y)
    w, b = fit_svm(rows, y)
    a = max(float(a), 1e-3)
    return w.astype(np.float32), a, float(c + a * b + prior_shift(sizes, y))


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float, float]:
    """The model. Features are made where the texts are; one task fits on at most ``2 * per_class`` of them."""
    sample, sizes = training_sample(docs, labels, label, learnable, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, feature = indicators(texts(b.column(0)))
            cut = np.searchsorted(row, np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in np.split(feature, cut)], pa.binary()), b.column(1)], ["features", "label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((f, y) for b in batches for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        y = np.array([y for _, y in found], np.int64)
        order = np.random.default_rng(0).permutation(len(y))
        w, a, c = fit_model([np.frombuffer(found[i][0], "<i4") for i in order], y[order], sizes)
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "a": [a], "c": [c]})

    features = sample.mapInArrow(extract, "features binary, label int")
    model = features.repartition(1).mapInArrow(fit, "w binary, a double, c double").collect()  # one row of 1 MB
    return (np.frombuffer(model[0]["w"], np.float32), model[0]["a"], model[0]["c"]) if model else fit_model([], np.zeros(0, np.int64), sizes)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``: the probability of label 1 from the whole text.

    Null and empty texts have no n-grams and get the intercept's score. Repeated rows get equal scores. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, c = shared.value
        for b in slices(batches):
            odds = a * margins(texts(b.column(1)), w) + c
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))], ["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        w, a, c = shared.value
        docs = [x or "" for x in column]
        parts = [margins(docs[k : k + 256], w) for k in range(0, len(docs), 256)]
        odds = a * np.concatenate(parts or [np.zeros(0)]) + c
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

    return docs.where(scored(F.col("text").cast("string")) >= threshold)
