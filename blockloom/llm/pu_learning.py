"""Positive-unlabelled learning shared by the quality and the toxicity classifier.

A linear model is fitted with numpy by minimising the non-negative unbiased risk: with prior p, the
positive part is p E_P[l(g)], and the negative part E_U[l(-g)] - p E_P[l(-g)], which is kept from
falling below zero by stepping against its gradient whenever it gets there. The loss is
logistic, so the sigmoid of the model estimates the probability of label 1 under that prior. A prior of
0 or 1 (no label 1, or no other) leaves nothing to learn: every score is then the prior itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kth_smallest, text_or_empty, written

#: Documents at most that a classifier is fitted on: trusted positives, and unlabelled ones.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def nn_pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float, cp: np.ndarray, cu: np.ndarray) -> tuple[float, float]:
    """The positive part of the risk and the (possibly negative) estimate of the negative part.

    gp and gu are the model's values, cp and cu the shares of the sample that have them.
    """
    loss = lambda z: np.logaddexp(0, -z)
    return prior * (cp @ loss(gp)), cu @ loss(-gu) - prior * (cp @ loss(-gp))


def nn_pu_gradient(gp: np.ndarray, gu: np.ndarray, prior: float, cp: np.ndarray, cu: np.ndarray) -> np.ndarray:
    """The step's direction by the model's values: that of the risk, or, where the negative part has fallen
    below zero, against that part."""
    negative = np.concatenate([-prior * cp * sigmoid(gp), cu * sigmoid(gu)])
    if nn_pu_risk(gp, gu, prior, cp, cu)[1] < 0:
        return -negative
    return negative + np.concatenate([-prior * cp * sigmoid(-gp), 0 * gu])


def fit_nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model; Adam over the whole sample (equal rows taken together).

    Whole-sample steps matter: in small batches the estimate of the negative part falls below zero by
    chance alone, and the correction then holds the model back from being sure of anything.
    """
    (xp, cp), (xu, cu) = (np.unique(x, axis=0, return_counts=True) for x in (xp, xu))
    cp, cu = cp / cp.sum(), cu / cu.sum()
    x = np.vstack([xp, xu]).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    n, theta = len(xp), np.zeros(x.shape[1])
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = (x @ theta.astype(np.float32)).astype(np.float64)
        d = nn_pu_gradient(g[:n], g[n:], prior, cp, cu)
        grad = (d.astype(np.float32) @ x).astype(np.float64)
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= (rate * (1 - t / steps) + 1e-4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def held_out(id_col: str, mod: int, remainder: int):
    """Whether labels of this row are never learnt from; a null id isn't held out (it has no label)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, float]:
    """(positive, text) of a bounded sample of the rows that may be learnt from, and the class prior.

    Positives are documents whose labels are all 1; unlabelled are any documents, drawn by a hash of
    their ids. The prior is the share of label 1 among all rows that may be learnt from, as it stands.
    Of both kinds at most as many as asked for are drawn; of rows that repeat an id, one counts.
    """
    judged = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, remainder)).groupBy("doc_id").agg(F.min(label).alias("y"))
    judged = judged.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 62)))
    n = judged.agg(F.sum("y").alias("p"), F.avg("y").alias("prior")).first()
    if not n["p"]:
        return docs.select(F.lit(True).alias("positive"), text_or_empty("text").alias("text")).limit(0), 0.0
    liked = judged.where("y = 1")
    trusted = liked.where(F.col("draw") <= kth_smallest(liked, "draw", max_positive)).select(F.col("doc_id").alias("id"))
    mine = docs.where(~held_out("doc_id", mod, remainder)).select("doc_id", text_or_empty("text").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 62)).alias("draw"))
    # A first cut by the share that is wanted, so that the threshold is looked for among few ids.
    ids = mine.agg(F.approx_count_distinct("draw")).first()[0]
    near = mine.where(F.col("draw") < int(min(1, 1.3 * max_unlabelled / max(1, ids)) * (1 << 62)))
    last = kth_smallest(near.select("draw").distinct(), "draw", max_unlabelled)
    positive = mine.join(F.broadcast(trusted), F.col("doc_id") == F.col("id"), "left_semi").select(F.lit(True).alias("positive"), "doc_id", "text")  # bounded by max_positive
    unlabelled = near.where(F.col("draw") <= (-1 if last is None else last)).select(F.lit(False).alias("positive"), "doc_id", "text")
    once = positive.unionByName(unlabelled).groupBy("positive", "doc_id").agg(F.min("text").alias("text"))
    return written(once.select("positive", "text")), float(n["prior"])
