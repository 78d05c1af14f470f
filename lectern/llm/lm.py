"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates mixed per context-frequency bucket.

The counts of all n-grams never meet in one place. Texts are cut into chunks of tokens where they are read; a chunk
sends its distinct n-grams, as sorted hashes with counts, to those buckets of hash ranges that they fall into. A bucket adds up the counts of
all chunks and answers every chunk with the totals of just the n-grams it asked for. Back in its chunk a token thus
has every count it needs. Hot words are no hot keys: a chunk sends each n-gram once.

Part of the training documents is deleted from the counts and kept for tuning: its tokens are counted by context
bucket and by the sizes of their estimates, and expectation-maximisation on that table (of fixed size) gives each
bucket its mixture weights. Scores then use the counts of all training documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrays import bucket_of, filled, in_batches, packed, packed_sorted, small, unpacked, unpacked_sorted
from lectern.llm.common import column, fold, slices, text_of, written

FOLDS, HELD_OUT = 7, 2
TUNING = 10
CHUNK_TOKENS = 2_000_000
BUCKET_BYTES = 8 << 20
#: Buckets whose totals are added up in one group, and buckets that a task of a shuffle answers.
TOTALS_OF = 4096
BUCKETS_PER_TASK = 4
#: Bits of a bigram's hash that are kept; those of words are kept whole, since exact counts rest on them.
BIGRAM_BITS = 48
#: Bits of the words' hashes that bigram hashes are made from; a chunk carries just these along.
WORD_BITS = 40
OCTAVES = 64  # counts are 64-bit numbers, so no estimate is less than 2^-64
LEVELS = OCTAVES + 1  # context-frequency buckets: powers of two
FINE = (4, 2)  # classes per octave of the bigram and of the unigram estimate
STEPS = OCTAVES * max(FINE) + 2  # sizes of an estimate told apart when tuning
END = xxhash.xxh64_intdigest(b"")


def tokens(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _bigram_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = u * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - BIGRAM_BITS)


class _Chunk:
    """Token ids of some documents. Id 0 is the end of a text, which also stands before its first token."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.hashes = [END]
        self.docs: list = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, remainder: int, tuning: bool, text: str) -> None:
        ids, hashes, out = self.ids, self.hashes, []
        for word in tokens(text):
            i = ids.get(word)
            if i is None:
                i = ids[word] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(word))
            out.append(i)
        out.append(0)
        self.parts.append(np.array(out, np.int32))
        self.docs.append((doc_id, len(out), remainder != HELD_OUT, tuning and remainder != HELD_OUT))
        self.size += len(out)

    def rows(self, chunk: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, chunk, payload): the documents under a key of their own, then the n-grams by bucket."""
        hashes = np.array(self.hashes, np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids, hashes = place[np.concatenate(self.parts)], hashes[order]
        self.ids, self.hashes, self.parts = {}, [], []
        short = hashes >> np.uint64(64 - WORD_BITS)
        sizes = np.array([d[1] for d in self.docs])
        train = np.repeat([d[2] for d in self.docs], sizes)
        tune = np.repeat([d[3] for d in self.docs], sizes)
        yield -1 - chunk, chunk, pickle.dumps((self.docs, int(place[0]), packed_sorted(short), packed(ids)))
        found = [(hashes, 64, ids)]
        _, pairs, at = _bigrams(ids, sizes, int(place[0]), short)
        found.append((pairs, BIGRAM_BITS, at))
        counts = [[np.bincount(at[x], minlength=len(keys)) for x in (train, tune)] for keys, _, at in found]
        named, cuts = filled(*[bucket_of(keys, bits, buckets) for keys, bits, _ in found])
        for i, b in enumerate(named.tolist()):
            payload = []
            for (keys, _, _), cut, (n_train, n_tune) in zip(found, cuts, counts, strict=True):
                part = slice(cut[i], cut[i + 1])
                payload += [packed_sorted(keys[part]), packed(small(n_train[part])), packed(small(n_tune[part]))]
            yield b, chunk, pickle.dumps(payload)


def _before(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """For every token the one before it; the end mark stands before a text."""
    before = np.concatenate(([end], ids[:-1])).astype(np.int64)
    before[np.cumsum(sizes)[:-1]] = end
    return before


def _bigrams(ids: np.ndarray, sizes: np.ndarray, end: int, hashes: np.ndarray):
    """The token before each token, the sorted distinct bigram hashes, and the place of each token's bigram there."""
    before = _before(ids, sizes, end)
    codes, at = np.unique(before * len(hashes) + ids, return_inverse=True)
    pairs = _bigram_hash(hashes[codes // len(hashes)], hashes[codes % len(hashes)])
    order = np.argsort(pairs, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return before, pairs[order], place[at]


def _cut(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, chunk = TaskContext.get().partitionId() << 24, 0, _Chunk()

        for batch in slices(batches):
            names = ("doc_id", "remainder", "tuning", "text")
            for doc in zip(*[column(batch, n) for n in names], strict=True):
                chunk.add(*doc)
                if chunk.size >= CHUNK_TOKENS:
                    yield from in_batches(chunk.rows(base + number, buckets))
                    number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield from in_batches(chunk.rows(base + number, buckets))

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Adds up one bucket and answers each chunk with the counts of its n-grams; documents pass unchanged.

    The bucket's own totals go, under a key below zero, to be added to those of other buckets.
    """
    bucket = group["bucket"][0].as_py()
    if bucket < 0:
        return group
    chunks, asked = group["chunk"].to_pylist(), [pickle.loads(p.as_py()) for p in group["payload"]]
    answers: list[list[bytes]] = [[] for _ in chunks]
    totals: list[int] = []
    for kind in (0, 3):
        keys = [unpacked_sorted(p[kind]) for p in asked]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for which in (1, 2):
            counts = np.concatenate([unpacked(p[kind + which]) for p in asked])
            sums.append(np.bincount(at, counts, len(known)).astype(np.int64))
        if kind == 0:  # tokens and distinct words, for training and for tuning
            fit = sums[0] - sums[1]
            totals = [int(sums[0].sum()), int((sums[0] > 0).sum()), int(fit.sum()), int((fit > 0).sum())]
        for part, answer in zip(np.split(at, np.cumsum([len(k) for k in keys])[:-1]), answers, strict=True):
            answer += [packed(small(s[part])) for s in sums]
    payloads = [pickle.dumps(x) for x in (*answers, totals)]
    columns = {
        "bucket": pa.array([bucket] * len(payloads), pa.int64()),
        "chunk": pa.array([*chunks, -1 - bucket // TOTALS_OF], pa.int64()),
        "payload": pa.array(payloads, pa.binary()),
    }
    return pa.table(columns)


def _level(counts: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, then one per power of two."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS - 1)


def _step(estimate: np.ndarray, fine: int) -> np.ndarray:
    """Size class of an estimate: 0 for none, then parts of an octave downwards."""
    with np.errstate(divide="ignore"):
        steps = 1 + np.floor(-np.log2(estimate) * fine)
    return np.where(estimate > 0, np.clip(steps, 1, STEPS - 1), 0).astype(np.int64)


def _gathered(group: pa.Table) -> pa.Table:
    """A chunk with the counts of its tokens and those that its tuning tokens teach by; or the totals of some buckets."""
    payloads = group["payload"]
    if group["chunk"][0].as_py() < 0:
        totals = np.sum([pickle.loads(p.as_py()) for p in payloads], axis=0)
        return _gathered_row(None, None, totals.tolist())
    order = np.argsort(np.array(group["bucket"]), kind="stable").tolist()
    docs, end, hashes, ids = pickle.loads(payloads[order[0]].as_py())
    hashes, ids = unpacked_sorted(hashes), unpacked(ids)
    answers = [pickle.loads(payloads[i].as_py()) for i in order[1:]]
    joined = [np.concatenate([unpacked(a[i]).astype(np.int64) for a in answers]) for i in range(4)]
    word, word_tune, pair, pair_tune = joined
    sizes = np.array([d[1] for d in docs])
    before, _, at = _bigrams(ids, sizes, end, hashes)
    tune = np.repeat([d[3] for d in docs], sizes)
    learned = ((word - word_tune)[before[tune]], (pair - pair_tune)[at[tune]], (word - word_tune)[ids[tune]])
    payload = pickle.dumps((docs, end, packed(ids), packed(small(word)), packed(small(pair[at]))))
    return _gathered_row(payload, pickle.dumps([packed(small(x)) for x in learned]), None)


def _gathered_row(payload: bytes | None, tuning: bytes | None, totals: list[int] | None) -> pa.Table:
    columns = {
        "payload": pa.array([payload], pa.binary()),
        "tuning": pa.array([tuning], pa.binary()),
        "totals": pa.array([totals], pa.list_(pa.int64())),
    }
    return pa.table(columns)


def _cells(n_fit: int):
    """Tuning tokens by class: context bucket, size of the bigram's estimate and of the word's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                context, pair, word = (unpacked(x).astype(np.int64) for x in pickle.loads(payload.as_py()))
                both = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
                one = word / max(n_fit, 1)
                cells = (_level(context) * STEPS + _step(both, FINE[0])) * STEPS + _step(one, FINE[1])
                cell, times = np.unique(cells, return_counts=True)
                arrays = [pa.array(cell.astype(np.int32)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "times"])

    return run


def tuned(cells: np.ndarray, times: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per context bucket, by expectation-maximisation.

    Buckets without tuning tokens share what one token of each estimate would teach: equal weights.
    """
    level, both, one = cells // STEPS // STEPS, cells // STEPS % STEPS, cells % STEPS
    p2 = np.where(both > 0, np.exp2(-(both - 0.5) / FINE[0]), 0)
    p1 = np.where(one > 0, np.exp2(-(one - 0.5) / FINE[1]), 0)
    parts = np.stack([p2, p1, np.full(len(p1), uniform)], axis=1)
    weights = np.full((LEVELS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # a context never seen has no bigram estimate
    for _ in range(rounds):
        share = parts * weights[level]
        share *= (times / share.sum(1))[:, None]
        mass = np.stack([np.bincount(level, share[:, i], LEVELS) for i in range(3)], axis=1) + 0.01
        mass[0, 0] = 0
        weights = mass / mass.sum(1, keepdims=True)
    return weights


def _scores(weights: np.ndarray, n: int, v: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                docs, end, ids, word, pair = pickle.loads(payload.as_py())
                ids, word, pair = unpacked(ids), unpacked(word).astype(np.int64), unpacked(pair)
                sizes = np.array([d[1] for d in docs])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                context, count = word[_before(ids, sizes, end)], word[ids]
                mix = weights[_level(context)]
                model = (
                    mix[:, 0] * np.divide(pair, context, out=np.zeros(len(ids)), where=context > 0)
                    + mix[:, 1] * (count / max(n, 1)) + mix[:, 2] / (v + 1)
                )
                sums = [
                    np.add.reduceat(x, starts)
                    for x in (np.log10((count + 1) / (n + v + 1)), np.log10(model), (count > 0).astype(np.int64))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in docs], pa.int64()), pa.array([not d[2] for d in docs]),
                        pa.array(sizes.astype(np.int64)), pa.array(sums[2]),
                        pa.array(np.full(len(docs), n, np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its tokens, the base score and the model's, log10.

    A null or empty text is one token, its end. A null doc_id counts as fold 0 and so is learned from; repeated rows
    are documents of their own. Without any training document all counts are 0 and only the uniform part is left.

    The rows must come in one order whenever they are read, as those of a table do: a lost task is run again and has to
    cut the same chunks. Write the result of a shuffle before it is given here.
    """
    spark = docs.sparkSession
    body = text_of()
    size = docs.select(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(size // BUCKET_BYTES, BUCKETS_PER_TASK * partitions))
    tasks = buckets // BUCKETS_PER_TASK  # grows with the texts, so that a task does not
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id"), FOLDS).cast("int").alias("remainder"),
        (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(TUNING)) == 0).alias("tuning"), body.alias("text"),
    )
    sent = "bucket long, chunk long, payload binary"
    asked = rows.mapInArrow(_cut(buckets), sent).repartition(tasks, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(_answer, sent).repartition(tasks, "chunk")
    gathered = answered.groupBy("chunk").applyInArrow(_gathered, "payload binary, tuning binary, totals array<long>")
    chunks = written(gathered, "lm-chunks")
    sums = chunks.filter(F.col("totals").isNotNull()).agg(*[F.sum(F.get("totals", F.lit(i))) for i in range(4)]).first()
    n, v, n_fit, v_fit = (x or 0 for x in sums)
    cells = chunks.filter(F.col("tuning").isNotNull()).select("tuning").mapInArrow(_cells(n_fit), "cell int, times long")
    counts = cells.groupBy("cell").agg(F.sum("times").alias("times")).collect()
    cell = np.array([r["cell"] for r in counts], np.int64)
    times = np.array([r["times"] for r in counts], np.float64)
    weights = tuned(cell, times, 1 / (1 + v_fit))
    texts = chunks.filter(F.col("payload").isNotNull()).select("payload")
    return texts.mapInArrow(_scores(weights, n, v), SCHEMA)


def op5(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
