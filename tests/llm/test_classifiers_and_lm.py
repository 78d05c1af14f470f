"""Quality, toxicity and language-model scores: held-out results and counts by hand."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import arrays, lm, quality, toxicity
from lectern.llm.common import training_labels


def auc(rows):
    rows = sorted(rows)
    positive = sum(y for _, y in rows)
    rank, total, i = 0.0, 0.0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        total += sum(y for _, y in rows[i:j]) * ((i + j + 1) / 2)
        i = j
    rank = total - positive * (positive + 1) / 2
    return rank / (positive * (len(rows) - positive))


def held(i, folds=5):
    return zlib.crc32(str(i).encode()) % folds == 0


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize(
    ("op", "label", "least"), [(quality.op3, "quality", 0.9), (toxicity.op9, "toxic", 0.9)]
)
def test_held_out_ranking(tables, op, label, least):
    docs, labels = tables
    rows = op(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    got = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc(got) > least


@pytest.mark.parametrize("op", [quality.op3, toxicity.op9])
def test_odd_rows(spark, make, op):
    rows = [(i, "good calm words here" if i % 2 else "idiot !!! $$$ %%%") for i in range(60)]
    rows += [(None, "x"), (100, None), (101, ""), (102, "long " * 50_000), (103, "é" * 10_000), (5, "again"), (5, "again")]
    labels = [(i, i % 2, 1 - i % 2, "text") for i in range(60)] + [(None, 1, 0, "a"), (3, None, None, "b"), (3, 1, 0, "c")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = op(make(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    good = [r["score"] for r in got if r["doc_id"] in range(1, 60, 2) and r["doc_id"] != 5]
    bad = [r["score"] for r in got if r["doc_id"] in range(0, 60, 2)]
    assert (min(good) > max(bad)) if op is quality.op3 else (max(good) < min(bad))
    again = op(make(rows), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert op(make(rows).limit(0), labels).collect() == []
    assert len(op(make(rows), labels.limit(0)).collect()) == len(rows)


def test_training_rows_are_bounded_and_never_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    got = training_labels(labels, "doc_id", "toxic", 5, 500).collect()
    assert 350 < len(got) < 650 and not any(held(r["doc_id"]) for r in got)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_a_repeated_key_teaches_once(spark, make, module, label, monkeypatch):
    """The driver receives one row per training key, whatever the order and the number of its rows."""
    learned = []
    if module is quality:
        monkeypatch.setattr(quality.Network, "fit", lambda self, x, y: learned.append((x.tolist(), y.tolist())))
    else:
        monkeypatch.setattr(toxicity, "train", lambda y, *x: learned.append((str(x), y.tolist())))
    once = [i for i in range(1, 60) if not held(i)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], f"doc_id long, {label} int")
    rows = [(i, f"some text {i}") for i in range(1, 60)] + [(once[0], f"again {i % 7}") for i in range(3000)]
    for partitions in (1, 5):
        module.fit(make(rows, partitions), labels)
    assert [y for _, y in learned] == [[float(i % 2) for i in once]] * 2
    assert learned[0] == learned[1]


def test_pooling_takes_the_whole_text():
    vectors = np.eye(quality.WORDS, quality.SIZE, dtype=np.float32)
    ids = quality.token_ids()("a b c " * 1000 + "!")
    assert len(ids) == 3001 and ids[-1] == ord("!")
    assert quality.pooled(ids, vectors).shape == (2 * quality.SIZE,)
    assert list(quality.token_ids()("the the THE 12")) [1] == quality.REPEAT


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    truth = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    assert 2.5 < quality.Network._calibrated(truth * 3, y) < 3.6


def test_swaps_change_the_group_and_nothing_else():
    assert toxicity.swapped("The Muslim women went") == "the jewish men went"
    assert toxicity.swapped("nobody here") is None


def test_counterfactuals_spare_neutral_mentions():
    rng = random.Random(3)
    ids_of = toxicity.features()
    words = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            body[3] = rng.choice(["idiot", "scum", "moron"])
            if rng.random() < 0.8:
                body[5] = "muslims"  # the group is named in most toxic texts of the sample
        elif rng.random() < 0.05:
            body[5] = rng.choice(["christians", "muslims"])
        texts.append(" ".join(body))
        y.append(float(toxic))
    plain = [ids_of(t) for t in texts]
    others = [None if (s := toxicity.swapped(t)) is None else ids_of(s) for t in texts]
    fair = toxicity.train(np.array(y), plain, others)
    unfair = toxicity.train(np.array(y), plain, others, swap_weight=0.0)
    neutral, other = ids_of("w1 w2 muslims w3"), ids_of("w1 w2 jews w3")
    gap = [abs(m.logit(neutral) - m.logit(other)) for m in (fair, unfair)]
    assert gap[0] < 0.3 * gap[1]
    assert fair.logit(neutral) < 0 < fair.logit(ids_of("w1 w2 idiot w3"))


def words_of(text):
    return (text or "").encode().lower().split() + [b""]


def base(rows):
    """Counts and base scores by hand."""
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words_of(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = words_of(t)
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        known = sum(counts[w] > 0 for w in words)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words), known, n, score))
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 50])
def test_base_scores(make, chunk, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of And and é ü x\x1cy z").strip() for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(None, "a B c"), (200, None), (201, ""), (202, "x\x0by\x0c\x85z "), (3, "rep"), (3, "rep"), (300, "long " * 20_000)]
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    got = sorted(map(tuple, lm.op5(make(rows)).collect()), key=str)
    want = sorted(base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)


def test_no_rows_and_no_training(make):
    assert lm.op5(make([(1, "a")]).limit(0)).collect() == []
    only_held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.op5(make([(i, "a b") for i in only_held])).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in got] == [(0, 0)] * 3


def test_mixture_matches_the_counts(make):
    """The model's score from counts in plain Python and the weights that were learned."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a b", "c d", "e", "f g h"]) for _ in range(20))) for i in range(200)]
    seen = {}
    real = lm.tuned

    def spy(*args):
        seen["weights"] = real(*args)
        return seen["weights"]

    lm.tuned = spy
    try:
        got = {r["doc_id"]: r["score"] for r in lm.op5(make(rows)).collect()}
    finally:
        lm.tuned = real
    one, two = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = words_of(t)
            one.update(words)
            two.update(zip([b"", *words], words))
    n, v, w = sum(one.values()), len(one), seen["weights"]
    for i, t in rows[:40]:
        words, total = words_of(t), 0.0
        for u, x in zip([b"", *words], words):
            mix = w[min(int(one[u]).bit_length(), lm.LEVELS - 1)]
            total += math.log10(
                mix[0] * (two[u, x] / one[u] if one[u] else 0) + mix[1] * one[x] / n + mix[2] / (v + 1)
            )
        assert abs(total - got[i]) < 1e-6 * abs(total)


def test_model_beats_base_on_held_out_texts(tables):
    rows = lm.op5(tables[0]).filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert rows["m"] > rows["b"]


def test_weights_by_expectation_maximisation():
    cells, times = [], []
    for both, one, k in ((5, 20, 900.0), (0, 20, 100.0)):
        cells.append((3 * lm.STEPS + both) * lm.STEPS + one)
        times.append(k)
    w = lm.tuned(np.array(cells), np.array(times), 1e-4)
    assert abs(w.sum(1) - 1).max() < 1e-9 and w[0, 0] == 0
    assert w[3, 0] > 0.5 and w[3, 1] > w[3, 2]


def test_no_estimate_and_no_context_is_clipped():
    counts = 2 ** np.arange(63)
    assert len(set(lm._level(counts).tolist())) == len(counts) and lm._level(counts).max() < lm.LEVELS
    for fine in lm.FINE:
        steps = lm._step(1 / counts, fine)
        assert (np.diff(steps) == fine).all() and steps.max() < lm.STEPS
    assert lm.LEVELS * lm.STEPS**2 < 1 << 31


def test_rare_bigrams_of_a_frequent_context_do_not_outweigh_the_unigrams():
    context, one = np.array([1 << 26]), lm._step(np.array([2.0**-20]), lm.FINE[1])
    cells = (lm._level(context) * lm.STEPS + lm._step(1 / context, lm.FINE[0])) * lm.STEPS + one
    w = lm.tuned(cells, np.array([1000.0]), 1e-9)[lm._level(context)[0]]
    assert w[1] > 0.9


def test_arrays_survive_packing():
    rng = np.random.default_rng(2)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(5, dtype=np.int32)):
        assert (arrays.unpacked(arrays.packed(a)) == a).all()
    s = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (arrays.unpacked_sorted(arrays.packed_sorted(s)) == s).all()


def test_a_chunk_sends_to_the_buckets_it_fills_and_no_others():
    chunk = lm._Chunk()
    chunk.add(1, 0, False, "a b a b c")
    chunk.add(None, 2, False, "")
    rows = list(chunk.rows(5, 1 << 30))
    assert rows[0][:2] == (-6, 5) and all(r[1] == 5 for r in rows)
    buckets = [r[0] for r in rows[1:]]
    # Words a, b, c and the end; bigrams: end-a, a-b, b-a, b-c, c-end, end-end.
    assert buckets == sorted(set(buckets)) and len(buckets) == 10


def test_filled_buckets():
    a, b = np.array([0, 0, 3, 9], np.uint64), np.array([3, 7], np.uint64)
    named, (cut_a, cut_b) = arrays.filled(a, b)
    assert named.tolist() == [0, 3, 7, 9]
    assert cut_a.tolist() == [0, 2, 3, 3, 4] and cut_b.tolist() == [0, 0, 1, 2, 2]
    named, (cut,) = arrays.filled(np.zeros(0, np.uint64))
    assert named.tolist() == [] and cut.tolist() == [0]


def test_many_buckets_give_the_same_scores(make, monkeypatch):
    """Buckets grow with the texts; most of them get a few n-grams, or none, of a chunk."""
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 40))) for i in range(200)] + [(None, None), (3, "w1 w2")]
    want = sorted(map(tuple, lm.op5(make(rows)).collect()), key=str)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 40)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(lm, "BUCKETS_PER_TASK", 64)
    got = sorted(map(tuple, lm.op5(make(rows)).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
