"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

1. One pass over all texts counts which tokens stand near which. Every token has a fixed sparse random index vector;
   the sum of the index vectors around a token (and its own) over the whole corpus is its word vector. Words are
   hashed to ``WORDS`` ids, marks and a few shapes of words have ids of their own, so the table of vectors has a fixed
   size. Each task adds up its own part and the parts are summed by Spark.
2. A document is the mean and the spread of its token vectors, over its whole text.
3. A network with one hidden layer learns from at most ``TRAIN`` labelled documents; part of them is kept back to fit
   the temperature that divides its logits.
4. A last pass scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import column, fold, slices, text_of, training_labels, training_texts

WORDS = 4096
RESERVED = 256
UPPER, REPEAT, NUMBER, LONG = 1, 2, 3, 4
SIZE = 32
REACH = 2
TRAIN = 20_000
FOLDS = 5
CACHE = 200_000
#: Tokens whose counts of neighbours are copied as floats at a time.
SLAB = 256
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]")


def index_vectors(seed: int = 11) -> np.ndarray:
    """Four entries of +-1 per token id."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS, SIZE), np.float32)
    for row in out:
        row[rng.choice(SIZE, 4, replace=False)] = rng.choice([-1.0, 1.0], 4)
    return out


def _id(token: str) -> int:
    if len(token) == 1 and ord(token) < RESERVED and not token.isalnum():
        return ord(token)
    if token.isdigit():
        return NUMBER
    if len(token) > 1 and token.isupper():
        return UPPER
    if len(token) > 30:
        return LONG
    return RESERVED + zlib.crc32(token.lower().encode()) % (WORDS - RESERVED)


def token_ids() -> Callable[[str], np.ndarray]:
    """A function from text to token ids; it remembers a bounded number of words."""
    known: dict[str, int] = {}

    def of(text: str) -> np.ndarray:
        if len(known) > CACHE:
            known.clear()
        out = []
        for token in TOKEN.findall(text):
            i = known.get(token)
            if i is None:
                i = known[token] = _id(token)
            out.append(i)
        ids = np.array(out, np.int64)
        if len(ids) > 1:  # a token that repeats the one before is a shape of its own
            again = np.concatenate(([False], ids[1:] == ids[:-1]))
            ids = np.where(again, REPEAT, ids)
        return ids

    return of


def _sums(near: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Per token the index vectors before, behind and of itself, added up: whole numbers, so the order does not matter.

    A product with floats copies the counts as floats, twice their size; that is done for a slab of them at a time.
    """
    index = index_vectors().astype(np.float64)
    sums = seen[:, None] * index
    for start in range(0, WORDS, SLAB):
        part = near[start : start + SLAB].astype(np.float64)
        sums[start : start + SLAB] += part @ index
        sums += part.T @ index[start : start + SLAB]
    return sums


def _context_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of the word vectors: rows of (token, sums of index vectors)."""
    ids_of, near = token_ids(), np.zeros(WORDS * WORDS, np.int32)
    seen = np.zeros(WORDS, np.int64)
    for batch in slices(batches):
        for text in column(batch, "text"):
            ids = ids_of(text)
            seen += np.bincount(ids, minlength=WORDS)
            for step in range(1, REACH + 1):
                np.add.at(near, ids[:-step] * WORDS + ids[step:], 1)
    sums = _sums(near.reshape(WORDS, WORDS), seen)
    rows = np.flatnonzero(seen)
    columns = [pa.array(rows, pa.int32())]
    columns += [pa.array(np.rint(sums[rows, d]).astype(np.int64)) for d in range(SIZE)]
    yield pa.RecordBatch.from_arrays(columns, ["token", *[f"c{d}" for d in range(SIZE)]])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Word vectors of unit length from the contexts in all texts (column ``text``, not null).

    The driver receives ``WORDS`` rows whatever the corpus.
    """
    fields = [f"c{d}" for d in range(SIZE)]
    schema = "token int, " + ", ".join(f"{c} long" for c in fields)
    parts = texts.select("text").mapInArrow(_context_counts, schema)
    rows = parts.groupBy("token").agg(*[F.sum(c).alias(c) for c in fields]).collect()
    out = np.zeros((WORDS, SIZE))
    for r in rows:
        out[r["token"]] = r[1:]
    total = out.sum(0)
    out -= (np.abs(out).sum(1, keepdims=True) / max(np.abs(out).sum(), 1)) * total  # what every context shares
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors; zeros for a text without tokens."""
    if not len(ids):
        return np.zeros(2 * SIZE, np.float32)
    share = np.bincount(ids, minlength=WORDS).astype(np.float32) / len(ids)
    used = np.flatnonzero(share)
    v, w = vectors[used], share[used]
    mean = w @ v
    return np.concatenate([mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))])


def _features(vectors: np.ndarray, keep: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids()
        for batch in slices(batches):
            rows = np.stack([pooled(ids_of(t), vectors) for t in column(batch, "text")]).astype(np.float32)
            found = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 2 * SIZE).cast(pa.list_(pa.float32()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, found], [*keep, "x"])

    return run


class Network:
    """x -> tanh(x A + a) b + c, standardised inputs, logits divided by a temperature."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0
        self.params: list[np.ndarray] = []

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-4) -> Network:
        """Adam on the mean log loss; a fifth of the rows is kept back for the temperature."""
        rng = np.random.default_rng(self.seed)
        width = x.shape[1]
        self.mean = x.mean(0) if len(x) else np.zeros(width)
        self.scale = x.std(0) + 1e-3 if len(x) else np.ones(width)
        self.params = [
            rng.normal(0, width**-0.5, (width, self.hidden)), np.zeros(self.hidden),
            rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1),
        ]
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        if not len(used):
            return self
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        z = (x - self.mean) / self.scale
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
                step += 1
                a, b, c, d = self.params
                h = np.tanh(z[rows] @ a + b)
                error = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(error, c) * (1 - h * h)
                grads = [z[rows].T @ back + decay * a, back.sum(0), h.T @ error + decay * c, np.array([error.sum()])]
                for p, g, m, v in zip(self.params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(held):
            self.temperature = self._calibrated(self.logits(x[held]), y[held])
        return self

    @staticmethod
    def _calibrated(logits: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss on rows the weights have not seen."""
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
        return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and a network from at most about ``most`` labelled rows outside fold 0.

    A key teaches by one row, so ``most`` bounds the labels that are broadcast and the rows that the driver receives.
    Without any, the scores are those of the untrained network and mean nothing.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    vectors = word_vectors(texts)
    train = training_labels(labels, "doc_id", label, FOLDS, most)
    rows = training_texts(docs, train, "doc_id", label)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(_features(vectors, ["doc_id", "y"]), f"doc_id {kind}, y int, x array<float>").toArrow().sort_by("doc_id")
    x = np.array(got["x"].combine_chunks().flatten(), np.float64).reshape(-1, 2 * SIZE)
    return vectors, Network().fit(x, np.array(got["y"], np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score``, 0 to 1, for every row; a null or empty text gets the score of no tokens.

    A column of ``docs`` that is named ``score`` and kept must be renamed first; all others pass as they are.
    """
    vectors, network = model
    # The features read a copy of the text, so that a kept text stays as it is, null or not.
    own = {c: f"_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], text_of().alias("text"))
    kept = list(own.values())

    def run(batches):
        for batch in _features(vectors, kept)(batches):
            x = np.array(batch.column(len(kept)).flatten(), np.float64).reshape(-1, 2 * SIZE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(network.scores(x))], [*kept, "score"])

    schema = StructType([f for f in rows.schema.fields if f.name != "text"]).add("score", "double")
    scored = rows.mapInArrow(run, schema)
    return scored.select(*[F.col(n).alias(c) for c, n in own.items()], "score")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score; fold 0 is never learned from."""
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
