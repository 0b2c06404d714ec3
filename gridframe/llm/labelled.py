"""What the two learned filters share: a bounded training sample, the fold rule, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import crc_of_id


def remainder(divisor: int) -> Column:
    return F.pmod(crc_of_id("doc_id"), F.lit(divisor))


def labels_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose document ``docs`` has."""
    return labels.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each class, as (text, label), and the classes' sizes over all labelled rows.

    Rows are chosen among those that ``docs`` has, by a hash of their id, so the choice neither depends on their order
    nor grows with the input. Null labels, other values than 0 and 1, and ids with both labels are left out. Where an id
    repeats, its least text counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(learnable)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    here = labels_of(docs, known)
    picked = [here.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows of an id and a label
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(few, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label"), sizes


def prior_shift(sizes: dict[int, int], sampled: np.ndarray) -> float:
    """What to add to log-odds learned on the sample so that they hold for the classes' true shares."""
    n = [max(1, sizes.get(k, 0)) for k in (0, 1)]
    m = [max(1, int((sampled == k).sum())) for k in (0, 1)]
    return float(np.log(n[1] / n[0]) - np.log(m[1] / m[0]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        w -= step / max(1, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return w
