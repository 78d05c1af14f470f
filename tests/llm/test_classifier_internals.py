"""The two classifiers' arithmetic against plain loops and numerical gradients."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import quality, toxicity


def test_word_vectors_equal_counted_contexts(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "12", ".", "delta", "delta", "é"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30))) for _ in range(40)] + ["", "alpha"]
    index = quality.index_vectors().astype(float)
    sums = np.zeros((quality.WORDS, quality.SIZE))
    for text in texts:
        raw = [quality._id(x) for x in quality.TOKEN.findall(text)]
        ids = [quality.REPEAT if i and raw[i] == raw[i - 1] else t for i, t in enumerate(raw)]
        for i, t in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                sums[t] += index[ids[j]]
    common, mass = sums.sum(0), np.abs(sums).sum()
    want = np.zeros_like(sums)
    for t, row in enumerate(sums):
        v = row - np.abs(row).sum() / mass * common
        want[t] = v / math.sqrt(sum(x * x for x in v)) if v.any() else v
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    assert np.abs(sums).sum() > 0 and got == pytest.approx(want, abs=1e-5)

    ids = quality.token_ids()(texts[0] or texts[1])
    rows = [got[i].astype(float) for i in ids]
    mean = [sum(r[d] for r in rows) / len(rows) for d in range(quality.SIZE)]
    spread = [math.sqrt(max(sum((r[d] - mean[d]) ** 2 for r in rows) / len(rows), 0)) for d in range(quality.SIZE)]
    # A spread of nothing but rounding is the root of the least float.
    assert quality.pooled(ids, got) == pytest.approx(np.array(mean + spread), abs=1e-3)


def test_counting_contexts_holds_the_counts_once():
    """A product of all counts with floats would hold a copy of them, twice as large: 192 MB a task in place of 64 MB."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(200)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    (got,) = quality._context_counts([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6

    near, seen = np.zeros((quality.WORDS, quality.WORDS), np.int32), np.zeros(quality.WORDS, np.int64)
    for ids in map(quality.token_ids(), texts):
        np.add.at(seen, ids, 1)
        for step in range(1, quality.REACH + 1):
            np.add.at(near, (ids[:-step], ids[step:]), 1)
    index = quality.index_vectors().astype(float)
    want = near @ index + near.T @ index + seen[:, None] * index
    used = np.flatnonzero(seen)
    assert got["token"].to_pylist() == used.tolist()
    assert (np.stack([np.array(got[f"c{d}"]) for d in range(quality.SIZE)], axis=1) == want[used]).all()


def test_network_forward_pass_and_gradient():
    """The first step of Adam is the sign of the gradient, here of a loss written down in full."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 3)), (rng.random(50) < 0.4).astype(float)
    rate, decay = 1e-3, 1e-2
    start = quality.Network(hidden=4).fit(x, y, epochs=0)
    moved = quality.Network(hidden=4).fit(x, y, epochs=1, rate=rate, decay=decay)
    used = np.random.default_rng(3)
    for size in ((3, 4), 4):
        used.normal(size=size)
    rows = used.permutation(50)[10:]

    def logit(params, row):
        a, b, c, d = params
        z = [(row[k] - start.mean[k]) / start.scale[k] for k in range(3)]
        hidden = [math.tanh(sum(z[k] * a[k, j] for k in range(3)) + b[j]) for j in range(4)]
        return sum(h * c[j] for j, h in enumerate(hidden)) + d[0]

    def loss(params):
        data = sum(math.log1p(math.exp(t)) - y[i] * t for i in rows for t in [logit(params, x[i])]) / len(rows)
        return data + decay / 2 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    assert [logit(start.params, r) for r in x] == pytest.approx(list(start.logits(x)))
    checked = 0
    for k, p in enumerate(start.params):
        for at in np.ndindex(p.shape):
            sides = []
            for h in (1e-5, -1e-5):
                other = [q.copy() for q in start.params]
                other[k][at] += h
                sides.append(loss(other))
            slope = (sides[0] - sides[1]) / 2e-5
            if abs(slope) > 1e-5:
                checked += 1
                assert moved.params[k][at] - p[at] == pytest.approx(-rate * np.sign(slope), rel=1e-2)
    assert checked > 15


@pytest.mark.parametrize("swap_weight", [0.0, 5.0])
def test_counterfactual_loss_by_numerical_gradient(monkeypatch, swap_weight):
    """A few steps on features 0 to 5 equal steps along the numerical gradient of the whole loss."""
    monkeypatch.setattr(toxicity, "FEATURES", 6)
    monkeypatch.setattr(toxicity, "LEAST_CHI2", 0.0)
    rng = np.random.default_rng(8)
    y = (rng.random(40) < 0.3).astype(float)
    plain = [np.flatnonzero(rng.random(6) < (0.7 if t else 0.4)) for t in y]
    others = [None if rng.random() < 0.5 else np.flatnonzero(rng.random(6) < 0.5) for _ in y]
    decay, steps = 1e-2, 6
    share = y.mean()

    def dot(p, ids):
        return sum(p[i] for i in ids)

    def loss(p):
        total = 0.0
        for t, ids in zip(y, plain, strict=True):
            z = dot(p, ids) + p[6]
            total += (0.5 / share if t else 0.5 / (1 - share)) / len(y) * (math.log1p(math.exp(z)) - t * z)
        total += decay / 2 * sum(v * v for v in p[:6])
        gaps = [dot(p, ids) - dot(p, o) for ids, o in zip(plain, others, strict=True) if o is not None]
        return total + swap_weight * sum(g * g for g in gaps) / len(gaps)

    p, first, second = np.zeros(7), np.zeros(7), np.zeros(7)
    for step in range(1, steps + 1):
        grad = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in np.eye(7) * 1e-5])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        p = p - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = toxicity.train(y, plain, others, steps=steps, decay=decay, swap_weight=swap_weight)
    assert np.append(model.weights, model.bias) == pytest.approx(p, abs=1e-6)
    assert model.logit(plain[0]) == pytest.approx(dot(p, plain[0]) + p[6], abs=1e-6)
