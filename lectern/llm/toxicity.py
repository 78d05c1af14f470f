"""Toxicity: a linear classifier over words, regularised by counterfactual swaps of identity terms.

Features are the distinct words of a text and their beginnings, hashed to ``FEATURES`` ids. From at most ``TRAIN``
labelled documents the driver keeps the features that tell the classes apart and fits a logistic regression. Every
labelled text that names a group is also read with the group swapped for another one, and the squared difference of
the two logits is added to the loss: what a text says of a group may count, which group it names may not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import column, fold, slices, text_of, training_labels, training_texts

FEATURES = 1 << 18
TRAIN = 20_000
FOLDS = 5
CACHE = 200_000
THRESHOLD = 0.5
WORD = re.compile(r"\w+")
PREFIX = 6
LEAST_TEXTS = 3
LEAST_CHI2 = 6.0
SWAP_WEIGHT = 5.0

#: Words that name a group; a counterfactual swaps one for another of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy", "mujeres", "hombres", "femmes", "hommes",
     "frauen", "männer"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "christian", "muslim", "jewish", "hindu",
     "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "mexican", "chinese", "indian", "immigrants",
     "refugees"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
)
_LINE_OF = {term: (i, j) for i, line in enumerate(IDENTITY_TERMS) for j, term in enumerate(line)}


def _ids(word: str) -> tuple[int, ...]:
    """Feature ids of a word: itself, and how it begins if it is longer."""
    whole = zlib.crc32(word.encode()) % FEATURES
    if len(word) <= PREFIX:
        return (whole,)
    return whole, zlib.crc32(("^" + word[:PREFIX]).encode()) % FEATURES


def features() -> Callable[[str], np.ndarray]:
    """A function from text to its distinct feature ids; it remembers a bounded number of words."""
    known: dict[str, tuple[int, ...]] = {}

    def of(text: str) -> np.ndarray:
        if len(known) > CACHE:
            known.clear()
        out: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = _ids(word)
            out.update(ids)
        return np.fromiter(out, np.int64, len(out))

    return of


def swapped(text: str) -> str | None:
    """The text in lower case with every identity term replaced by the next of its line; None when it has none."""
    found = False

    def other(match: re.Match) -> str:
        nonlocal found
        at = _LINE_OF.get(match[0])
        if at is None:
            return match[0]
        found = True
        line = IDENTITY_TERMS[at[0]]
        return line[(at[1] + 1) % len(line)]

    out = WORD.sub(other, text.lower())
    return out if found else None


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids_of = features()
    for batch in slices(batches):
        texts = column(batch, "text")
        plain = [np.sort(ids_of(t)) for t in texts]
        others = [None if (s := swapped(t)) is None else np.sort(ids_of(s)) for t in texts]
        kind = pa.list_(pa.int32())
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "y")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(plain, kind), pa.array(others, kind)], ["doc_id", "y", "x", "other"]
        )


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() + self.bias)


class _Rows:
    """Texts as one flat array of feature ids, for sums per text and per feature."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists], np.int64)
        self.n, self.row = len(lists), np.repeat(np.arange(len(lists)), sizes)
        self.ids = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.ids], self.n) if self.n else np.zeros(0)

    def spread(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, by_row[self.row], size) if self.n else np.zeros(size)


def train(y: np.ndarray, plain: list[np.ndarray], others: list[np.ndarray | None], steps: int = 200,
          decay: float = 2e-4, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Logistic regression by Adam on whole gradients, with the counterfactual penalty.

    Both classes weigh the same, as toxic texts are few and one half is where they are told apart.
    """
    if not len(y):
        return Model(np.zeros(FEATURES), 0.0)
    rows = _Rows(plain)
    positive = rows.spread(y, FEATURES)
    count = rows.spread(np.ones(len(y)), FEATURES)
    share, total = y.mean(), len(y)
    expected = count * share
    spread = expected * (1 - share) * (1 - count / total)
    chi2 = np.divide((positive - expected) ** 2, spread, out=np.zeros(FEATURES), where=spread > 0)
    useful = np.flatnonzero((count >= LEAST_TEXTS) & (chi2 >= LEAST_CHI2))
    place = np.full(FEATURES, -1)
    place[useful] = np.arange(len(useful))

    def kept(ids):
        at = place[ids]
        return at[at >= 0]

    rows = _Rows([kept(x) for x in plain])
    pairs = [(i, kept(o)) for i, o in enumerate(others) if o is not None]
    left, right = _Rows([kept(plain[i]) for i, _ in pairs]), _Rows([o for _, o in pairs])
    size = len(useful)
    w, bias = np.zeros(size), 0.0
    weight = np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / total
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(rows.dot(w) + bias, -30, 30))) - y) * weight
        grad = rows.spread(error, size) + decay * w
        if pairs:
            gap = 2 * swap_weight * (left.dot(w) - right.dot(w)) / len(pairs)
            grad += left.spread(gap, size) - right.spread(gap, size)
        grad = np.append(grad, error.sum())
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    weights = np.zeros(FEATURES)
    weights[useful] = w
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN) -> Model:
    """A model from at most about ``most`` labelled rows outside fold 0, whose features the driver receives.

    A key teaches by one row, so ``most`` bounds the labels that are broadcast and the rows that the driver receives.
    Without any, every score is one half.
    """
    train_on = training_labels(labels, "doc_id", label, FOLDS, most)
    texts = training_texts(docs, train_on, "doc_id", label)
    kind = texts.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(_labelled, f"doc_id {kind}, y int, x array<int>, other array<int>").toArrow().sort_by("doc_id")
    arrays = [[None if v.as_py() is None else np.array(v.values) for v in got[c]] for c in ("x", "other")]
    return train(np.array(got["y"], np.float64), *arrays)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score``, 0 to 1, for every row; a null or empty text gets the score of no words."""

    def run(batches):
        ids_of = features()
        for batch in slices(batches):
            logits = np.array([model.logit(ids_of(t)) for t in column(batch, "text")])
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score; fold 0 is never learned from."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
