"""Mixing: targets by repeated resharing, seats by ranking every quotient, shares by adding up."""

import random
import re

from pyspark.sql import functions as F

from lectern.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got, shard_words):
    """A source misses its target by no more than the short last block of each of its shards, and one block."""
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * (2 * (sizes[s] // shard_words + 1) + 1), (s, taken[s], want[s])


def test_mix(make, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rng = random.Random(1)
    rows = [
        (i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 300))), rng.choice(["a", "b", "é", None, "zz"]))
        for i in range(300)
    ]
    rows += [(i, "x y z\tq\x0bw", "tiny") for i in range(3)] + [(900, None, "empty"), (None, "a b", "a")]
    rows += [(901, "w " * 20_000, "a")] * 2
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got, 500)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_equal_rows_fill_many_shards(make, monkeypatch):
    """A third of the rows are one row; its copies spread over the shards and the mix still fits its targets."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "COPIES", 64)
    rows = [(7, "a b c d e f g h i j", "a")] * 1000 + [(None, None, "a")] * 150
    rows += [(1000 + i, "w " * (i % 20), "ab"[i % 2]) for i in range(1000)]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got, 500)
    shares = [r["taken"] for r in got if r["doc_id"] == 7]
    assert len(shares) == 1000 and all(0 <= s <= 20 for s in shares)
    slim = docs.selectExpr("doc_id", "source", "10L AS size", "pmod(xxhash64(doc_id, text), 1L << 60) AS h")
    numbered = mixing.number_copies(slim)
    assert numbered.count() == len(rows)
    shards = numbered.filter("doc_id = 7").groupBy(F.col("h") % 20).count().collect()
    assert len(shards) == 20 and max(r["count"] for r in shards) < 100
    again = mixing.number_copies(slim.repartition(7))
    assert numbered.exceptAll(again).count() == 0 and again.exceptAll(numbered).count() == 0


def test_no_words_and_no_rows(make):
    got = mixing.op7(make([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.op7(make([(1, "a", "b")]).limit(0)).collect() == []


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        units = [(g, f"u{i:02}", rng.choice([0, 1, 7, rng.randint(1, 10_000)])) for i in range(rng.randint(1, 12))]
        seats = rng.choice([0, 1, 3, rng.randint(1, 400)])
        if not sum(u[2] for u in units):
            seats = 0
        quotients = sorted(((-s / (2 * j - 1), u, j) for _, u, s in units if s for j in range(1, seats + 1)))[:seats]
        for _, u, s in units:
            want[g, u] = sum(q[1] == u for q in quotients)
            rows.append((g, u, s, seats))
    df = spark.createDataFrame(rows, "g int, u string, s long, n long")
    got = {(r["g"], r["u"]): r["got"] for r in mixing.apportion(df, ["g"], "u", "s", "n", "got").collect()}
    assert got == want


def test_words(spark):
    df = spark.createDataFrame([("a\x1cb \x85 c\x0b\x0cd",), ("",)], "t string")
    assert [r[0] for r in df.select(mixing.count_words(F.col("t"))).collect()] == [4, 0]
