"""Support-vector classification with the RBF kernel, as a linear machine over a Nyström map (ML-17).

A kernel machine compares every row with every other. Here the kernel is taken between a row and a fixed number of
landmarks, training rows drawn by a hash of their key, and turned by the inverse root of the landmarks' own kernel
matrix: products of mapped rows are then the kernel itself wherever one of the two is a landmark, and its best
approximation from these landmarks elsewhere. The linear machine on the mapped rows is a distributed fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import features as X
from lectern.session import cut

LANDMARKS = 200
SEED = 42
#: Share of the largest eigenvalue below which a direction of the landmarks is rounding noise.
NOISE = 1e-10
MAPPED = "_kernel"
#: Half the widths over which the hinge's corner is rounded, one after the other, and the most Newton steps at each.
#: The first takes in every row, the last is what the result is a minimum of.
ROUND = (1.5, 0.3)
STEPS = 20
#: Rows of one matrix, and tasks whose sums are added before the driver sees them.
BATCH = 4096
FANIN = 32


def default_gamma(rows: DataFrame, vec: str = "features") -> float:
    """One over the number of features times the variance of all their values; 1 where nothing varies."""
    row = rows.select(Summarizer.metrics("count", "sum", "normL2").summary(F.col(vec)).alias("s")).first()["s"]
    size = len(row["sum"])
    n = row["count"] * size
    if not n:
        return 1.0
    square = float((row["normL2"].toArray() ** 2).sum() / n)
    variance = square - float(row["sum"].toArray().sum() / n) ** 2
    return 1.0 / (size * variance) if variance > 1e-12 * square else 1.0


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


@dataclass
class KernelMap:
    """Landmarks (a bounded number of rows), the kernel's width and what turns kernel values into coordinates."""

    landmarks: np.ndarray
    gamma: float
    root: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * squared_distances(x, self.landmarks)) @ self.root

    def transform(self, df: DataFrame, vec: str = "features", output: str = MAPPED) -> DataFrame:
        """Adds the mapped vector; the other columns and their metadata stay."""
        apply = self.apply

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series(list(apply(np.stack(rows.to_numpy()))) if len(rows) else [], dtype=object)

        return df.withColumn(output, array_to_vector(mapped(vector_to_array(vec))))


def fit_map(
    train: DataFrame, key: str, gamma: float | None = None, count: int = LANDMARKS, seed: int = SEED,
    vec: str = "features",
) -> KernelMap:
    """A Nyström map with at most ``count`` landmarks: the training rows with the least hash draws of their key."""
    drawn = train.select(vector_to_array(vec).alias("x"), X.draw(key, seed).alias("h"), F.col(key).alias("k"))
    rows = drawn.orderBy("h", "k").limit(count).collect()
    if not rows:
        raise ValueError("no training rows")
    landmarks = np.unique(np.array([r["x"] for r in rows]), axis=0)
    gamma = default_gamma(train, vec) if gamma is None else gamma
    values, vectors = np.linalg.eigh(np.exp(-gamma * squared_distances(landmarks, landmarks)))
    kept = values > NOISE * values.max()
    return KernelMap(landmarks, gamma, vectors[:, kept] / np.sqrt(values[kept]))


@dataclass
class KernelModel:
    """A kernel map and a linear machine per class behind it (one for two classes): weights, the last one a constant."""

    map: KernelMap
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        scores = _with_constant(self.map.apply(x)) @ self.weights.T
        return (scores[:, 0] > 0).astype(float) if len(self.weights) == 1 else scores.argmax(axis=1).astype(float)

    def transform(self, df: DataFrame, vec: str = "features") -> DataFrame:
        decide = self.decide

        @F.pandas_udf("double")
        def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series(decide(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

        return df.withColumn("prediction", said(vector_to_array(vec)))


def _with_constant(mapped: np.ndarray) -> np.ndarray:
    return np.concatenate((mapped, np.ones((len(mapped), 1))), axis=1)


def _summed(rows: DataFrame, compute: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (x, label) of what ``compute`` makes of a batch; tasks add up first, then groups of tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                x = np.asarray(part.column(0).flatten()).reshape(part.num_rows, -1)
                own = compute(x, np.asarray(part.column(1)))
                total = own if total is None else total + own
        if total is not None:
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "sums"]
            )

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group["part"]))
        total = sum(np.asarray(group["sums"][int(i)].values) for i in order)
        return pa.table({"part": group["part"].take(pa.array(order[:1])), "sums": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "part long, sums array<double>")
    if rows.rdd.getNumPartitions() > FANIN:
        sums = sums.groupBy((F.col("part") / FANIN).cast("long")).applyInArrow(add, "part long, sums array<double>")
    found = sorted(sums.collect(), key=lambda r: r["part"])
    return sum(np.array(r["sums"]) for r in found)


def _sides(label: np.ndarray, machines: int) -> np.ndarray:
    """+1 for the class of each machine, -1 for the others: (rows, machines)."""
    if machines == 1:
        return np.where(label == 1, 1.0, -1.0)[:, None]
    return np.where(label[:, None] == np.arange(machines), 1.0, -1.0)


def _loss(margin: np.ndarray, width: float) -> np.ndarray:
    """Hinge with its corner rounded over ``width`` to either side."""
    short = 1 + width - margin
    return np.where(margin < 1 - width, 1 - margin, np.where(short > 0, short**2 / (4 * width), 0.0))


def _newton(rows: DataFrame, mapping: KernelMap, machines: int, ridge: float, n: int) -> np.ndarray:
    """Weights that minimise the mean loss plus ``ridge`` / 2 times their square, all machines at once.

    Each step is one pass that adds up loss, gradient and curvature at the weights it was sent to; a machine whose loss
    went up goes back and takes a quarter of its step.
    """
    size = mapping.root.shape[1] + 1
    penalty = np.append(np.full(size - 1, ridge), 0.0)

    def at(weights: np.ndarray, width: float):
        def of(x, label):
            mapped, y = _with_constant(mapping.apply(x)), _sides(label, machines)
            margin = y * (mapped @ weights.T)
            slope = y * np.clip((margin - 1 - width) / (2 * width), -1, 0)
            bent = np.abs(1 - margin) <= width
            return np.stack([
                np.concatenate((
                    np.full((1, size), _loss(margin[:, c], width).sum()), (slope[:, c] @ mapped)[None],
                    mapped[bent[:, c]].T @ mapped[bent[:, c]],
                ))
                for c in range(machines)
            ])

        return of

    weights = np.zeros((machines, size))
    for width in ROUND:
        best, tried, step, done = np.full(machines, np.inf), weights, np.zeros_like(weights), np.zeros(machines, bool)
        for _ in range(STEPS):
            found = _summed(rows, at(tried, width)).reshape(machines, size + 2, size) / n
            value = found[:, 0, 0] + (penalty * tried**2).sum(axis=1) / 2
            better = value <= best
            for c in range(machines):
                if better[c]:
                    gradient = found[c, 1] + penalty * tried[c]
                    bend = found[c, 2:] / (2 * width) + np.diag(penalty + 1e-9)
                    step[c] = -np.linalg.solve(bend, gradient)
                    done[c] = -gradient @ step[c] <= 1e-4 * value[c]
                else:
                    step[c] /= 4
            weights, best = np.where(better[:, None], tried, weights), np.minimum(value, best)
            if done.all():
                break
            tried = weights + step
    return weights


def fit_classifier(train: DataFrame, key: str, n_classes: int, penalty: float = 1.0) -> KernelModel:
    """Support vectors with cost ``penalty`` per training row; several classes are told apart one against the rest."""
    mapping = fit_map(train, key)
    rows = cut(train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")))
    n = max(rows.count(), 1)
    weights = _newton(rows, mapping, 1 if n_classes <= 2 else n_classes, 1.0 / (penalty * n), n)
    return KernelModel(mapping, weights)
