"""Quality classifier: a sparse ensemble of rules over statistics of texts.

Small boosted trees are grown on the driver from labelled rows bounded by ``SAMPLE``.
Every path from a root to a node is a rule, a conjunction of bounds on statistics. A
logistic model with an L1 penalty (FISTA) weighs the rules; those with a weight are
compiled into one Spark column, so scoring is a projection in whole-stage code.

Defined results: a null or empty text is scored by its statistics, which are all 0;
labels of null count as none; without any labels every score is 0.5; rows with equal texts
have equal scores, whatever their ids; a row of a repeated id is learned from with each of its labels; texts of any length are
read whole; an empty table gives an empty table; columns other than the id and the text are not carried along,
whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, documents
from .quality_rules import matrix
from .text_stats import ALL, sample_by_hash, with_statistics

#: Labelled rows to learn from, at most about.
SAMPLE = 20000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 0.0015, 400
NAMES = tuple(c for c in ALL if c not in ("n_words", "word_chars", "n_symbols"))
#: Sorted bounds: (statistic, above the value rather than at most it, value).
Rule = tuple[tuple[int, bool, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules from boosted trees: each fits the gradient that the ones before leave."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    score, rules = np.zeros(len(y)), {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, out: np.ndarray) -> None:
        out[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        if path:
            rules[tuple(sorted(path))] = None
        if len(path) == DEPTH or len(rows) < 20:
            return
        best = (1e-6, 0, 0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f, c in enumerate(cuts):
            gs = np.cumsum(np.bincount(bins[rows, f], g[rows], len(c) + 1))
            hs = np.cumsum(np.bincount(bins[rows, f], h[rows], len(c) + 1))
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - whole
            gain[(n < 5) | (n[-1] - n < 5)] = 0
            if len(c) and (k := int(gain[:-1].argmax())) >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[0] > 1e-6:
            _, f, k = best
            low = bins[rows, f] <= k
            for above, part in ((False, rows[low]), (True, rows[~low])):
                split(part, g, h, (*path, (f, above, float(cuts[f][k]))), out)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        out = np.zeros(len(y))
        split(np.arange(len(y)), y - p, p * (1 - p), (), out)
        score += RATE * out
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, above, at in rule:
            out[:, k] *= (x[:, f] > at) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by FISTA."""
    n = len(y)
    one = np.column_stack([np.ones(n), r])
    rate = 4 * n / np.linalg.norm(one, 2) ** 2
    w = z = np.zeros(one.shape[1])
    t = 1.0
    for _ in range(steps):
        step = z - rate * (one.T @ (1 / (1 + np.exp(-(one @ z))) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (last - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


class RuleModel:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rules, self.weights, self.bias = [], np.zeros(0), 0.0
        if len(y) and 0 < y.sum() < len(y):
            rules = grow_rules(x, y)
            self.bias, weights = lasso(holds(rules, x), y)
            used = np.flatnonzero(np.abs(weights) > 1e-4)
            self.rules, self.weights = [rules[k] for k in used], weights[used]
        elif len(y):
            self.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for f, above, at in rule:
                c = F.col(NAMES[f])
                test = test & ((c > at) if above else (c <= at))
            total = total + F.when(test, F.lit(float(w))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def remainder(n: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """``labels``: doc_id and quality of the rows to learn from."""
    known = labels.where("quality IS NOT NULL").select("doc_id", "quality")
    rows = stats.join(sample_by_hash(known, sample, ["doc_id"], seed=8), "doc_id").select("quality", *NAMES).collect()
    x, y = matrix(rows, NAMES), np.array([float(r["quality"]) for r in rows])
    by = np.lexsort((*x.T, y))  # the order in which rows come doesn't matter
    return RuleModel(x[by], y[by])


def scored(stats: DataFrame, model: RuleModel, cut: float = 0.3) -> DataFrame:
    return stats.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``score`` and ``predicted`` of all documents; learns where the remainder of ids isn't 0."""
    stats = Stash(spark, "quality").put(with_statistics(docs))
    return scored(stats, fit(stats, labels.where(remainder(5) != 0)))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")
