"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, words do not. Words and word beginnings that mark toxic documents of a bounded sample label
the tokens: a token of a toxic document is toxic if one of its forms is so marked. A two-state field over word features
is fitted to the labelled tokens; forward-backward marginals give every token's probability, the strongest and the sum
of them give the document's score, and tokens above one half are the offending spans.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import MEMO_ENTRIES, MEMO_ENTRY_BYTES, memo, slices, texts
from gridframe.llm.labelled import logistic, prior_shift, training_sample

#: Labelled documents of each class, and their tokens together, that the fit takes at most. Documents are taken whole.
SAMPLE_PER_CLASS = 2000
SAMPLE_TOKENS = 400_000
BITS = 20
#: Lengths of word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: A form marks toxic documents if so many times their share of the others have it, and if chance would put all of the
#: toxic documents that have it on that side with at most this probability.
#: Where no form reaches the first ratio, the next one counts.
MIN_RATIOS, CHANCE = (15.0, 8.0, 4.0), 1e-5
#: How far the transitions' odds ratio may go, as a logarithm: a constraint of the fit. Messages then shrink by
#: tanh(9 / 4) = 0.978 a token at least, so lead-ins of below 1000 tokens are exact.
MAX_SPREAD = 9.0
SPANS = "array<struct<begin:int,end:int,p:double>>"

_TOKEN = re.compile(r"\S+")
_SIGNS = string.punctuation + "«»“”„‘’…¡¿"


def core(word: str) -> str:
    """Lower case without signs at either end."""
    return word.lower().strip(_SIGNS)


def forms(word: str) -> list[str]:
    w = core(word)
    return [f"w{w}"] + [f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k] + [f"s{w[-3:]}"]


def features(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(f) >> (64 - BITS) for f in forms(word)] if core(word) else [0]


def toxic_forms(docs: list[list[str]], y: np.ndarray) -> set[str]:
    """Forms that mark toxic documents, from document frequencies; chance alone gives none of this many and no others."""
    counts, n, seen = [Counter(), Counter()], [1, 1], set()
    for words, label in zip(docs, y, strict=True):
        if (copy := (int(label), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))) in seen:  # a copy counts once in its class
            continue
        seen.add(copy)
        n[label] += 1
        counts[label].update({f for w in set(words) for f in forms(w)[:-1]})
    least = max(4, math.log(CHANCE) / math.log(n[1] / sum(n)))
    for ratio in MIN_RATIOS:
        if found := {f for f, a in counts[1].items() if a >= least and a / n[1] >= ratio * (counts[0][f] + 0.5) / n[0]}:
            return found
    return set()


class Chain:
    """Texts as padded segments, so that the recursions run over many segments at once.

    A segment has a lead-in and a run-out of ``burn`` tokens of its document. Messages of a two-state chain forget where
    they began by a factor that the transitions fix; ``burn`` is long enough for any trace to fall below rounding.
    """

    def __init__(self, sizes: np.ndarray, burn: int):
        length = max(256, 2 * burn)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        per = -(-sizes // length)
        doc = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = starts[doc] + nth * length
        longest = int(min(length, sizes.max(initial=0)))
        steps = longest + 2 * (burn if (per > 1).any() else 0)
        lead = burn if (per > 1).any() else 0
        at = begin[None, :] - lead + np.arange(steps)[:, None]
        self.valid = (at >= starts[doc]) & (at < starts[doc + 1])
        self.at = np.where(self.valid, at, 0)
        self.core = self.valid & (at >= begin) & (at < begin + length)
        self.first = at == starts[doc]
        self.last = at == starts[doc + 1] - 1
        self.total = int(starts[-1])

    def messages(self, emit: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward odds of state 1 at each place of each segment, and the emission odds."""
        (t00, t01), (t10, t11) = np.exp(transitions[:2])
        start = math.exp(transitions[2, 1] - transitions[2, 0])
        e = np.exp(np.clip(emit, -30, 30))[self.at] if self.total else np.zeros(self.at.shape)
        forward, backward = np.empty_like(e), np.empty_like(e)
        f = np.full(e.shape[1], start)
        for k in range(len(e)):
            into = (t01 + t11 * f) / (t00 + t10 * f)
            f = e[k] * np.where(self.first[k] | ~self.valid[k], start, into)
            forward[k] = f
        b = np.ones(e.shape[1])
        for k in range(len(e) - 1, -1, -1):
            b = np.where(self.last[k] | ~self.valid[k], 1.0, b)
            backward[k] = b
            z = e[k] * b
            b = (t10 + t11 * z) / (t00 + t01 * z)
        return forward, backward, e

    def flat(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.total)
        out[self.at[self.core]] = values[self.core]
        return out


def burn_in(transitions: np.ndarray) -> int:
    """Tokens after which a message has forgotten its origin to 1e-9: the contraction of a positive 2 by 2 matrix."""
    factor = math.tanh(abs(spread(transitions)) / 4)
    return 1 if factor < 1e-9 else max(1, math.ceil(math.log(1e-9) / math.log(factor)))


def spread(transitions: np.ndarray) -> float:
    """The logarithm of the odds ratio between staying and changing."""
    return float(transitions[0, 0] + transitions[1, 1] - transitions[0, 1] - transitions[1, 0])


def marginals(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each token's probability of being toxic."""
    if not len(emit):
        return np.zeros(0)
    chain = Chain(sizes, burn_in(transitions))
    forward, backward, _ = chain.messages(emit, transitions)
    odds = forward * backward
    return chain.flat(odds / (1 + odds))


class FieldGradient:
    """The gradient of the mean negative log-likelihood of ``gold`` under the field, with a quadratic penalty.

    ``tokens``: the word of each token; ``table`` and ``mask``: the words' features, numbered densely.
    """

    def __init__(self, tokens: np.ndarray, table: np.ndarray, mask: np.ndarray, gold: np.ndarray, sizes: np.ndarray, burn: int, penalty: float):
        self.tokens, self.table, self.mask, self.gold, self.penalty = tokens, table, mask, gold, penalty
        self.chain = chain = Chain(sizes, burn)
        self.flow = chain.core & ~chain.last
        here = chain.at[self.flow]
        self.pairs = np.bincount(gold[here] * 2 + gold[here + 1], minlength=4).reshape(2, 2)
        self.begin = chain.first & chain.core
        self.first = np.bincount(gold[chain.at[self.begin]], minlength=2)
        if self.flow[-1].any():  # the next token lies in the run-out, which a segment that fills its steps lacks
            raise AssertionError("a segment has no run-out")

    def __call__(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chain, flow, n = self.chain, self.flow, len(self.tokens)
        emit = ((w[self.table] * self.mask).sum(1))[self.tokens]
        forward, backward, e = chain.messages(emit, t)
        odds = forward * backward
        p = odds / (1 + odds)
        by_word = np.bincount(self.tokens, chain.flat(p) - self.gold, len(self.table))
        gw = np.bincount(self.table.ravel(), (by_word[:, None] * self.mask).ravel(), len(w)) / n + self.penalty * w
        f, z = forward[:-1][flow[:-1]], (e * backward)[1:][flow[:-1]]
        pairs = np.exp(t[:2])[:, :, None] * np.stack([[np.ones_like(f), z], [f, f * z]])
        pairs /= pairs.sum((0, 1))
        at_first = p[self.begin]
        first = np.array([(1 - at_first).sum(), at_first.sum()])
        gt = np.vstack([pairs.sum(2) - self.pairs, first - self.first]) / n + self.penalty * t
        return gw, gt


def fit_field(tokens: np.ndarray, table: np.ndarray, mask: np.ndarray, gold: np.ndarray, sizes: np.ndarray, steps: int = 60, penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions (rows: from state 0, from 1, start) that make ``gold`` likely, by Adam.

    Segments of the fit have a lead-in of 24 tokens, so its gradients are near, not exact; the fitted field is applied
    exactly. The transitions' spread is held to ``MAX_SPREAD``.
    """
    used, dense = np.unique(table, return_inverse=True)
    gradient = FieldGradient(tokens, dense.reshape(mask.shape), mask, gold, sizes, 24, penalty)
    w, t = np.zeros(len(used)), np.zeros((3, 2))
    slow = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        for k, (x, g) in enumerate(zip((w, t), gradient(w, t), strict=True)):
            slow[2 * k] += 0.1 * (g - slow[2 * k])
            slow[2 * k + 1] += 0.01 * (g * g - slow[2 * k + 1])
            x -= 0.3 * (slow[2 * k] / (1 - 0.9**step)) / (np.sqrt(slow[2 * k + 1] / (1 - 0.99**step)) + 1e-9)
        over = spread(t) - np.clip(spread(t), -MAX_SPREAD, MAX_SPREAD)
        t[:2] -= over / 4 * np.array([[1, -1], [-1, 1]])
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return weights, t


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document, the log-odds of its strongest token and the log of one plus its expected toxic tokens."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    top = np.zeros(len(sizes))
    np.maximum.at(top, row, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    strong = np.bincount(row, np.where(p >= 0.5, p, 0.0), len(sizes))
    return np.column_stack([np.log(top / (1 - top)), np.log1p(strong)])


def affordable(sizes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the documents that the fit takes, in their order: each class's whole documents until the next is too long
    for the tokens left; one that all the tokens would not hold is passed over."""
    left, taken = [SAMPLE_TOKENS, SAMPLE_TOKENS], []
    for k, (n, label) in enumerate(zip(sizes.tolist(), y.tolist(), strict=True)):
        if n <= left[label]:
            left[label] -= n
            taken.append(k)
        elif n <= SAMPLE_TOKENS:
            left[label] = -1
    return np.array(taken, np.int64)


def fit_model(docs: list[str], y: np.ndarray, sizes: dict[int, int]) -> dict:
    """Weights, transitions and calibration; without both classes, or without any marking form, the smoothed share of label 1."""
    taken = affordable(np.array([len(x.split()) for x in docs], np.int64), y)
    words, y = [docs[k].split() for k in taken], y[taken]
    marked = toxic_forms(words, y) if len(y) else set()
    share = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    empty = {"w": np.zeros(1 << BITS, np.float32), "t": np.zeros((3, 2)), "c": np.array([0, 0, np.log(share / (1 - share))])}
    if not marked:
        return empty
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for doc in words for w in doc))}
    known = list(vocabulary)
    table, mask = np.zeros((len(known), 2 + len(PREFIXES)), np.int64), np.zeros((len(known), 2 + len(PREFIXES)))
    for k, w in enumerate(known):
        f = features(w)
        table[k, : len(f)], mask[k, : len(f)] = f, 1
    bad = np.array([any(f in marked for f in forms(w)[:-1]) for w in known])
    lengths = np.array([len(x) for x in words])
    tokens = np.array([vocabulary[w] for doc in words for w in doc])
    gold = (bad[tokens] & (np.repeat(y, lengths) == 1)).astype(np.int64)
    w, t = fit_field(tokens, table, mask, gold, lengths)
    emit = ((w[table] * mask).sum(1))[tokens]
    c = logistic(summary(marginals(emit, lengths, t), lengths), y, penalty=0.1)
    c[-1] += prior_shift(sizes, y)
    return {"w": w.astype(np.float32), "t": t, "c": c}


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """The model, fitted in one task on at most ``2 * per_class`` labelled documents."""
    sample, sizes = training_sample(docs, labels, label, learnable, per_class)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x or "", y) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r[0].encode("utf-8", "replace")), r))
        m = fit_model([x for x, _ in rows], np.array([y for _, y in rows], np.int64), sizes)
        yield pa.RecordBatch.from_pydict({"w": [m["w"].tobytes()], "t": [m["t"].tobytes()], "c": [m["c"].tobytes()]})

    row = sample.repartition(1).mapInArrow(fit, "w binary, t binary, c binary").collect()  # one row of 4 MB
    if not row:
        return fit_model([], np.zeros(0, np.int64), sizes)
    return {"w": np.frombuffer(row[0]["w"], np.float32), "t": np.frombuffer(row[0]["t"]).reshape(3, 2), "c": np.frombuffer(row[0]["c"])}


class Scorer:
    """Scores of texts under a model; a memo holds the emissions of words seen before."""

    def __init__(self, model: dict):
        self.w, self.t, self.c = model["w"], model["t"], model["c"]
        self.known: dict[str, float] = memo(f"toxicity {xxhash.xxh64_hexdigest(self.w.tobytes())}", dict)

    def emissions(self, words: list[list[str]]) -> np.ndarray:
        if len(self.known) > MEMO_ENTRIES:
            self.known.clear()
        new = {x: float(self.w[features(x)].sum()) for x in set().union(*words).difference(self.known)}
        self.known.update(new)
        out = np.array([self.known[x] for doc in words for x in doc], float)
        for x in new:
            if len(x) > MEMO_ENTRY_BYTES // 4:
                del self.known[x]
        return out

    def score(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, every token's probability, and the documents' numbers of tokens."""
        words = [x.split() for x in docs]
        sizes = np.array([len(x) for x in words], np.int64)
        p = marginals(self.emissions(words), sizes, self.t)
        odds = summary(p, sizes) @ self.c[:2] + self.c[2]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700))), p, sizes


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Code points of the tokens above one half."""
    bad = set(np.flatnonzero(p >= 0.5).tolist())
    if not bad:
        return []
    return [{"begin": m.start(), "end": m.end(), "p": float(p[k])} for k, m in enumerate(_TOKEN.finditer(text)) if k in bad]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, spans) for every row of ``docs(doc_id, text)``, from whole texts.

    Null and empty texts have no tokens: the lowest summary, no spans. Repeated rows get equal results. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, 512):
            x = texts(b.column(1))
            s, p, sizes = scorer.score(x)
            each = np.split(p, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array([spans(d, q) for d, q in zip(x, each, strict=True)], kind)], ["doc_id", "score", "spans"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(run, f"doc_id long, score double, spans {SPANS}")


def keep_clean(docs: DataFrame, model: dict, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score stays below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for column in columns:
            docs = [x or "" for x in column]
            parts = [scorer.score(docs[k : k + 256])[0] for k in range(0, len(docs), 256)]
            yield pd.Series(np.concatenate(parts or [np.zeros(0)]))

    return docs.where(scored(F.col("text").cast("string")) < threshold)
