"""The Jaccard join against all pairs compared in plain Python."""

import random

import numpy as np
import pytest

from lectern.llm import jaccard
from lectern.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def expected(rows):
    """doc number -> (class_id, group_id, n_links) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and alike(sets[i], sets[j])] for i in range(n)]
    out, group = [], list(range(n))
    while True:
        new = [min([group[i], *[group[j] for j in linked[i]]]) for i in range(n)]
        if new == group:
            break
        group = new

    def least(numbers):
        return min((rows[k][0] for k in numbers if rows[k][0] is not None), default=None)

    for i in range(n):
        same = [k for k in range(n) if sets[k] == sets[i]]
        tied = [k for k in range(n) if group[k] == group[i]]
        out.append((rows[i][0], least(same), least(tied), len(linked[i])))
    return out


def alike(a, b):
    return a == b or (a and b and len(a & b) * 5 >= 4 * len(a | b))


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append("  ".join(words) if rng.random() < 0.3 else " ".join(words).upper())
    rows += ["", None, " \n", "one two", "One  two", "three", "é é é é é é", "x " * 30_000]
    rng.shuffle(rows)
    texts = [(i if i % 17 else None, t) for i, t in enumerate(rows)]
    return texts + texts[3:9]


@pytest.mark.parametrize("block", [1024, 3])
def test_all_pairs(make, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    got = [tuple(r) for r in jaccard.op1(make(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


def test_one_document_of_each_group_stays(make):
    rows = corpus()
    left = jaccard.one_of_each(make(rows))
    assert left.columns == make(rows).columns
    kept = left.collect()
    groups = {(g if g is not None else str(shingles(t))) for (_, _, g, _), (_, t) in zip(expected(rows), rows)}
    assert len(kept) == len(groups)
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} >= {g for g in groups if isinstance(g, int)}


def test_empty_table(make):
    assert jaccard.op1(make([(1, "a")]).limit(0)).collect() == []
    assert jaccard.one_of_each(make([(1, "a")]).limit(0)).collect() == []


def test_depth_follows_the_target():
    assert jaccard.depth_for(0.8, 24, 8, 0.5) == 8
    assert jaccard.LEAST_DEPTH == 5 and 1 - (1 - 0.8**5) ** 24 >= jaccard.TARGET
    bands = np.zeros(jaccard.BANDS)
    assert jaccard.reached_depth(bands) == jaccard.FULL_DEPTH
    bands[-5:] = 1000  # all links above 0.95
    assert jaccard.reached_depth(bands) == jaccard.FULL_DEPTH
    bands[0] = 100  # a fiftieth of them at the threshold
    assert jaccard.LEAST_DEPTH < jaccard.reached_depth(bands) < jaccard.FULL_DEPTH
    bands[0] = 1e6
    assert jaccard.reached_depth(bands) == jaccard.LEAST_DEPTH


def depths(monkeypatch):
    """The depths at which classes are linked while a join runs."""
    seen, real = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda t, l, depth: (seen.append(depth), real(t, l, depth))[1])
    return seen


def changed(rng, base, changes):
    words = list(base)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"x{rng.random()}"
    return " ".join(words)


def test_dense_data_stop_at_a_longer_prefix(make, monkeypatch):
    rng = random.Random(2)
    bases = [[f"w{rng.randrange(10_000)}" for _ in range(400)] for _ in range(30)]
    close = [(i, changed(rng, bases[i % 30], 1)) for i in range(150)]
    seen = depths(monkeypatch)
    got = sorted(tuple(r) for r in jaccard.op1(make(close)).collect())
    assert seen == [jaccard.FULL_DEPTH] and got == sorted(expected(close))
    far = [(i, changed(rng, bases[i % 30], 0 if i < 30 else 7)) for i in range(150)]
    seen.clear()
    got = sorted(tuple(r) for r in jaccard.op1(make(far)).collect())
    assert seen == [jaccard.FULL_DEPTH, 6] and got == sorted(expected(far))


def test_recall_near_the_threshold(make):
    """Pairs just above the threshold, each on its own: of these at least nine in ten must be met."""
    rng, rows, pairs = random.Random(5), [], 300
    for i in range(pairs):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        # Two copies with two changes each, apart: up to 20 of 116 shingles differ on each side.
        rows += [(2 * i, " ".join(base)), (2 * i + 1, changed(rng, base, 2))]
    want = {d: n for d, _, _, n in expected(rows)}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.op1(make(rows)).collect()}
    assert sum(want.values()) > pairs
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[d] <= want[d] for d in want)


def test_long_texts_are_cut_into_blocks_by_bytes(make, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(jaccard, "BIN_BYTES", 2000)
    rows = corpus()
    got = [tuple(r) for r in jaccard.op1(make(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))


@pytest.mark.parametrize("dense", [0, 2, 64])
def test_shared_counts(dense, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rng = np.random.default_rng(1)
    table = rng.random((20, 50)) < 0.2
    rows, columns = np.nonzero(table)
    got = jaccard.shared(rows, columns, 20, 50, 12)
    want = table.astype(int) @ table.T.astype(int)
    off = ~np.eye(12, 20, dtype=bool)
    assert (got[off] == want[:12][off]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(50, 50), (60, 61), (61, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)} | {60: 60, 61: 60}
    assert got == want
