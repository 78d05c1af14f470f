"""The hash-prefix forest against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours

SCHEMA = "vec_id long, embedding array<{}>, label int, class string, score string, rank string, tree string"


def frame(spark, rows, kind="float", partitions=4):
    full = [(i, v, 0, "x", "y", "z", "t") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA.format(kind)).repartition(partitions)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows, asks, k=5, kind=np.float32):
    known = [(i, np.array(v, kind).astype(float)) for i, v in rows if usable(v)]
    out = []
    for at, (q, x) in enumerate(known):
        if q is None or not asks(q):
            continue
        near = []
        for other, (i, y) in enumerate(known):
            if other != at and len(x) == len(y):
                a, b = x / np.abs(x).max(), y / np.abs(y).max()
                score = sum(a * b) / (math.sqrt(sum(a * a)) * math.sqrt(sum(b * b)))
                near.append((-round(score, 9), i is None, i or 0))
        out += [(q, r, None if n else i, -s) for r, (s, n, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=str)


def plain(got):
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()), key=str)


def odd_rows(dims=6):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(12)]  # copies, more than k
    rows += [(200 + i, [x * 2 for x in rows[10][1]]) for i in range(3)]  # the same direction
    rows += rows[50:51] * 2  # repeated rows that ask
    rows += [(300, None), (350, []), (301, [0.0] * dims), (302, [-0.0] * dims), (303, [1.0, None] * (dims // 2))]
    rows += [(304, [math.nan] * dims), (305, [math.inf] * dims), (None, rows[5][1]), (None, [1.0] * dims)]
    rows += [(400 + i, [float(i + 1), 2.0]) for i in range(3)] + [(450, [5.0])]  # other lengths: 400 has two, 450 none
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_candidates_met(spark, monkeypatch, kind):
    """With few different vectors, or a target of nearly 1, the search is exact, ties and copies included."""
    monkeypatch.setattr(neighbours, "TARGET", 1 - 1e-12)
    rows = odd_rows()
    if kind == "double":
        rows += [(500, [1e200, 1e-200, 3e200, 0.0, 1.0, 1.0])]
    got = plain(neighbours.op11(frame(spark, rows, kind)))
    assert got == expected(rows, lambda i: i % 50 == 0, kind=np.float32 if kind == "float" else float)


def test_pieces_and_parts(spark, monkeypatch):
    """Blocks cut into pieces and queries into parts give the same rows."""
    monkeypatch.setattr(neighbours, "TARGET", 1 - 1e-12)
    monkeypatch.setattr(neighbours, "PIECE_BYTES", 64 * 6 * 4 // 64)
    monkeypatch.setattr(neighbours, "PART", 3)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=6)
    rows = [(i, (middle + rng.normal(size=6) * 0.05).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.normal(size=6).tolist()) for i in range(100)]
    got = plain(neighbours.search(frame(spark, rows), F.col("vec_id") % 3 == 0))
    assert got == expected(rows, lambda i: i % 3 == 0)


def test_recall(spark):
    """Queries of every kind: copies, clusters and noise in many dimensions."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([
        centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 32)) * 0.3, rng.normal(size=(2000, 32))
    ]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.op11(frame(spark, rows)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    queries = np.arange(0, 4000, 50)
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -9
    want = {(int(q), int(i)) for q, row in zip(queries, near) for i in np.argsort(-row)[:5]}
    assert len(got) == len(want)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    assert all(abs(r["score"] - near[r["query_id"] // 50, r["vec_id"]]) < 1e-12 for r in got)


def test_dense_data_stay_at_longer_prefixes(spark):
    scores = spark.createDataFrame([(1.0,), (0.95,), (0.8,), (0.4,), (-1.0,), (None,)], "score double")
    depth, trees = neighbours.depth_for(F.col("score"))
    got = scores.select("score", depth.alias("d"), trees.alias("t")).collect()
    depths = [r["d"] for r in got]
    assert depths == sorted(depths, reverse=True) and depths[0] == neighbours.BITS and depths[-2:] == [0, 0]
    for r in got[1:4]:
        p = 1 - math.acos(r["score"]) / math.pi
        here, lower = 1 - p ** r["d"], 1 - p ** (r["d"] + 1)
        missed = here ** r["t"] * lower ** (neighbours.TREES - r["t"])
        fewer = here ** (r["t"] - 1) * lower ** (neighbours.TREES - r["t"] + 1)
        assert missed <= 1 - neighbours.TARGET + 1e-12 < fewer + 1e-9


def test_empty(spark):
    assert neighbours.op11(frame(spark, []).limit(0)).collect() == []
    assert neighbours.op11(frame(spark, [(50, [1.0, 2.0])])).collect() == []
    assert neighbours.op11(frame(spark, [(1, [1.0, 2.0]), (2, None)])).collect() == []
