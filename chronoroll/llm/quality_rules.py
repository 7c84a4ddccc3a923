"""Quality rules: base rules, and an isolation forest on statistics of texts.

The forest is grown on the driver: each tree from ``LEAF`` rows of numbers of its own, drawn by hash from all
documents that pass the base rules, which is what an isolation tree is. A document's anomaly is 2 to the power of minus its mean
path length over the trees, in units of the mean path of a random tree, in steps of 1 / ``GRID``. Scoring runs
on all documents where they lie. The threshold is calibrated on all labelled rows that pass the base rules, which are
counted per step of anomaly and label: of the steps that drop no more than ``LOSS`` of the good ones, the one
with the largest share of bad ones dropped less ``WEIGHT`` times that of good ones. Trees are flat arrays, so a batch walks all of them in
``depth`` steps.

Defined results: a null or empty text has no words, fails the base rules and isn't
kept; without labels of good rows nothing but the base rules drops a document; rows with
equal texts have equal verdicts, whatever their ids; a row of a repeated id is calibrated with each of its labels; texts of any
length are read whole; an empty table gives an empty table; columns other than the id and the text are not carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, documents, map_batches
from .text_stats import COUNTS, RATIOS, sample_by_hash, with_statistics

TREES, LEAF, SEED = 128, 256, 11
#: Rows that the trees are grown from, about, and steps of anomaly between 0 and 1.
SAMPLE, GRID = TREES * LEAF, 10_000
#: The share of good labelled rows that the threshold may drop, and how many bad rows one of them outweighs.
LOSS, WEIGHT = 0.01, 5.0
USED = RATIOS
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def mean_path(n: np.ndarray) -> np.ndarray:
    """The mean depth of a search that fails in a random tree of n rows."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random splits of random subsamples; nodes of all trees in flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.depth = int(np.ceil(np.log2(max(2, leaf))))
        self.norm = float(mean_path(np.array([min(leaf, max(2, len(rows)))]))[0]) or 1.0
        nodes: list[list[float]] = []  # feature, split, left, right, path length of a leaf
        self.roots = []

        def grow(x: np.ndarray, depth: int) -> int:
            k = len(nodes)
            nodes.append([0, 0.0, k, k, depth + float(mean_path(np.array([len(x)]))[0])])
            wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < self.depth else []
            if len(wide):
                f = int(rng.choice(wide))
                at = rng.uniform(x[:, f].min(), x[:, f].max())
                below = x[:, f] <= at
                nodes[k][:2] = f, at
                nodes[k][2], nodes[k][3] = grow(x[below], depth + 1), grow(x[~below], depth + 1)
            return k

        own: list[np.ndarray] = []  # rows of the next trees; a tree has each row once
        for _ in range(trees if len(rows) else 0):
            if not own:
                order = rng.permutation(len(rows))
                own = [order[k : k + leaf] for k in range(0, max(1, len(rows) - leaf + 1), leaf)]
            self.roots.append(grow(rows[own.pop()], 0))
        table = np.array(nodes or [[0, 0, 0, 0, 0]])
        self.feature, self.left, self.right = table[:, 0].astype(int), table[:, 2].astype(int), table[:, 3].astype(int)
        self.split, self.path = table[:, 1], table[:, 4]

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        if not self.roots:
            return np.zeros(len(x))
        at = np.repeat(np.array(self.roots)[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[at]] <= self.split[at]
            at = np.where(below, self.left[at], self.right[at])
        return np.ceil(GRID * 2.0 ** (-self.path[at].mean(1) / self.norm)) / GRID


def matrix(rows: list, names: tuple[str, ...] = USED) -> np.ndarray:
    return np.array([[r[c] for c in names] for r in rows], float).reshape(-1, len(names))


def calibrate(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float = LOSS, weight: float = WEIGHT) -> float:
    """The threshold above which a document is dropped, from the numbers of good and bad rows per step of anomaly."""
    if not good.sum():
        return float("inf")
    by = np.argsort(steps)
    steps, good, bad = steps[by], good[by], bad[by]
    above = lambda n: (n.sum() - np.cumsum(n)) / max(1, n.sum())
    may = (above(good) <= loss) & (good > 0)
    return float(steps[may][np.argmax((above(bad) - weight * above(good))[may])])


def grown(stats: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> Forest:
    """A forest from about ``sample`` rows of those that pass the base rules."""
    some = sample_by_hash(stats.where(f"NOT ({BASE_FAILED})"), sample, [id_col, *USED]).select(*USED).toArrow()
    x = np.column_stack([some.column(c).to_numpy() for c in USED]) if some.num_rows else np.zeros((0, len(USED)))
    return Forest(x[np.lexsort(x.T)])


def anomalies(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``anomaly`` and ``base_failed``."""
    names = stats.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in USED]) if b.num_rows else np.zeros((0, len(USED)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.anomaly(x), pa.float64())], [*names, "anomaly"])

    return map_batches(stats, run, f"{fields}, anomaly double").withColumn("base_failed", F.expr(BASE_FAILED))


def threshold(scored: DataFrame, labels: DataFrame, loss: float = LOSS, id_col: str = "doc_id") -> float:
    """Calibrated on all labelled rows; one row per step of anomaly reaches the driver. ``labels``: doc_id and quality, 1 for good rows."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias(id_col), (F.col("quality") == 1).alias("good"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    rows = scored.where("NOT base_failed").select(id_col, "anomaly").join(known, id_col).groupBy("anomaly").agg(n(F.col("good")), n(~F.col("good"))).collect()
    return calibrate(*np.array(rows, float).reshape(-1, 3).T, loss)


def rules(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, all statistics, ``anomaly``, ``base_failed`` and ``kept``."""
    stash = Stash(spark, "rules")
    stats = stash.put(with_statistics(df, id_col, text_col))
    scored = stash.put(anomalies(stats, grown(stats, id_col=id_col)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold(scored, labels, id_col=id_col))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
