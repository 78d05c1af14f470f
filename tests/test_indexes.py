"""Stored indexes: the token index and the inverted lists of vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.operators import vector_index as I
from lectern.operators.term_index import TermIndex


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_term_index_grows_by_segments_and_takes_replays(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "Überzug", "x1"]
    rows = [(i % 40 if i % 9 else None, i % 3, " ".join(words[(i * j) % 7] for j in range(1, 2 + i % 6))) for i in range(90)]
    rows += rows[:5]  # repeated chunks
    chunks = spark.createDataFrame(rows, "doc long, chunk int, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gam über"), (3, ""), (4, None), (5, "zz x1")], "query_id int, query string")
    index = TermIndex(spark, str(tmp_path), ["doc", "chunk"])
    cols = ["query_id", "doc", "chunk", "text", "score"]

    def matches(df):
        return plain(R.keyword_matches(df, asked, ["doc", "chunk"], use_index=False).select(cols))

    index.add(chunks.filter("chunk = 0"), "first")
    assert plain(R.index_matches(index, asked).select(cols)) == matches(chunks.filter("chunk = 0"))
    index.add(chunks.filter("chunk = 1"), "second").add(chunks.filter("chunk = 1"), "second")
    index.add(chunks.filter("chunk > 1"), "third")
    want = matches(chunks)
    assert want and plain(R.index_matches(index, asked).select(cols)) == want
    assert plain(R.index_matches(index, asked, hot_rows=3).select(cols)) == want
    counted = {r["token"]: r["df"] for r in index.vocabulary().collect()}
    assert counted["x1"] == sum("x1" in r[2].split() for r in rows)


@pytest.mark.parametrize("sought", [128, 0])
def test_index_scores_from_postings(spark, tmp_path, monkeypatch, sought):
    monkeypatch.setattr(R, "MAX_SOUGHT_WORDS", sought)
    texts = ["Red stones, redstone", "heat and stone", "a stone", "", None, "redder heat heat", "stone red heat water"]
    rows = [(i % 4 or None, 0, texts[i % 7]) for i in range(40)]  # one key names different chunks
    chunks = spark.createDataFrame(rows, "doc long, chunk int, text string").repartition(3)
    asked = spark.createDataFrame([("a", "red stone"), ("b", "heat water"), ("c", "stone red heat of")], "query_id string, query string")
    index = TermIndex(spark, str(tmp_path), ["doc", "chunk"]).add(chunks, "1").add(chunks, "01")
    # Neither tokens nor keys travel with the chunks and postings that are scored.
    assert set(index.chunks().columns) == {"doc", "chunk", "text", "_part", "_row"}
    assert set(index.postings().columns) == {"token", "_part", "_row", "_nd"}
    cols = ["query_id", "doc", "chunk", "text", "score"]
    want = plain(R.keyword_matches(chunks.union(chunks), asked, ["doc", "chunk"], use_index=False).select(cols))
    assert want and plain(R.index_matches(index, asked).select(cols)) == want
    assert plain(R.index_matches(index, asked.limit(0)).select(cols)) == []


def odd(spark, n=500, dims=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.4
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + rows[5:7]  # copies and a repeated key
    rows += [(2000, None), (2001, [0.0] * dims), (2002, [1.0] * 3), (2003, [math.nan] * dims), (2004, [None] * dims)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4), rows, dims


def brute(rows, dims, asks, k):
    known = [(i, np.array(v)) for i, v in rows if v and len(v) == dims and all(x is not None and x == x for x in v) and any(v)]
    out = []
    for q, x in known:
        if asks(q):
            score = [(-round(float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y)), 6), i) for i, y in known]
            out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("piece, part", [(16384, 2048), (20, 3)])
def test_exact_search_leaves_lists_out_but_no_neighbour(spark, tmp_path, monkeypatch, piece, part):
    monkeypatch.setattr(I, "PIECE", piece)
    monkeypatch.setattr(I, "PART", part)
    df, rows, dims = odd(spark)
    index = I.VectorIndex(spark, str(tmp_path), "id", "v").build(df.filter("id < 300 OR id >= 1000"))
    index.add(df.filter("id >= 300 AND id < 1000"), "later").add(df.filter("id >= 300 AND id < 1000"), "later")
    assert index.vectors().count() == len(rows) - 5
    asked = df.filter("id % 10 = 0 AND id < 500").select(F.col("id").alias("q"), F.col("v").alias("w"))
    got = plain(index.search(asked, "q", "w", 5, digits=6).select("q", "id", "score", "rank"))
    assert [tuple(r) for r in got] == brute(rows, dims, lambda i: i % 10 == 0 and i < 500, 5)
    # The bound must be worth something on clustered data.
    sizes, radii = index.lists()
    near = I._routed(
        asked.select(F.col("q").alias("_query"), F.col("w").alias("_asked")).withColumn("_bound", F.lit(0.97)),
        index.centroids(), sizes, radii, 1,
    )
    assert near.count() < 0.5 * asked.count() * (sizes > 0).sum()


def test_probes_reach_the_recall_they_are_set_for(spark, tmp_path):
    df, rows, dims = odd(spark, 1500)
    index = I.VectorIndex(spark, str(tmp_path), "id", "v").build(df)
    probes = index.probes_for(0.95, 5)
    assert 1 <= probes <= len(index.centroids())
    asked = df.filter("id % 7 = 0 AND id < 1500").select(F.col("id").alias("q"), F.col("v").alias("w"))
    true = set(plain(index.search(asked, "q", "w", 6, digits=6).select("q", "id")))
    near = set(plain(index.search(asked, "q", "w", 6, probes=probes, digits=6).select("q", "id")))
    assert len(true & near) >= 0.9 * len(true)


def test_empty_index_and_queries(spark, tmp_path):
    df, _, _ = odd(spark)
    none = df.filter("id < 0")
    index = I.VectorIndex(spark, str(tmp_path / "a"), "id", "v").build(none)
    assert index.search(df.select("id", "v").withColumnsRenamed({"id": "q", "v": "w"}), "q", "w", 3).count() == 0
    index = I.VectorIndex(spark, str(tmp_path / "b"), "id", "v").build(df.filter("id = 3"))
    asked = df.filter("id in (4, 2000, 2001)").select(F.col("id").alias("q"), F.col("v").alias("w"))
    assert [(r["q"], r["id"]) for r in index.search(asked, "q", "w", 3).collect()] == [(4, 3)]
    assert index.search(asked.limit(0), "q", "w", 3).count() == 0
