"""The prefix trie against rebuilt conversations in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from lectern.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, v1 string, words string"
NAMES = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        cut = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:cut]) + tuple(turns[cut:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for seq in nodes:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)

    def weight(seq):
        return (len(nodes[seq]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0

    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        ends = ",".join(str(c) for c in sorted(members) if built[c] == seq)
        out.append((
            min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children.get(seq, [])),
            sum(s not in children for s in below), sum(map(weight, below)), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, -1, "x", "y") for r in rows], SCHEMA).repartition(partitions)
    got = prefix_trie.op13(df)
    assert got.columns == NAMES
    assert {f.name: f.dataType.simpleString() for f in got.schema.fields} == {n: "bigint" for n in NAMES[:-1]} | {
        "ends_sha256": "string"
    }
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations():
    rng = random.Random(3)
    texts = ["a", "a b", "b\tc\x0bd", "", None, "é ü", "a b"]
    rows = []
    for c in [*range(45), -1, -20, -25, 100, 101, 139]:
        turns = list(range(rng.randint(1, 6)))
        if rng.random() < 0.2:
            turns[0] = None
        rows += [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(texts)) for t in turns]
    rows += [(60, t, "user", "same") for t in range(4)] * 2  # repeated rows
    rows += [(61, 0, "user", x) for x in ("q", "p", "p")]  # ties
    rows += [(None, 0, "user", "nobody")]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 240) for t in range(5)]
    return rows


def test_against_rebuilt_lists(spark):
    rows = conversations()
    assert result(spark, rows) == expected(rows)


def test_long_conversation_over_many_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rng = random.Random(5)
    long = [(20, i, "user", rng.choice(["x", "y z"])) for i in range(300)]
    rows = long + [(21, i, "user", t) for _, i, _, t in long] + [(27, i, r, t) for _, i, r, t in long[:150]]
    rows += [(3, 0, "a", "w " * 50_000)]
    assert result(spark, rows) == expected(rows)


def test_turnless_and_empty(spark):
    # 41 loses its only turn to a head of three turns that its absent base can't give.
    lost = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lost, 0, "user", "gone")]
    assert result(spark, rows) == expected(rows) == [
        (lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())
    ]
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.op13(df).collect() == []
    assert result(spark, [(None, 1, "a", "b")]) == []


def test_prefixes_that_only_look_alike_are_found(spark):
    schema = "conv_id long, depth long, v1 long, v2 long, w1 long, w2 long, k1 long, k2 long, words long, last boolean"
    same = [(1, 2, 5, 6, 7, 8, 9, 10, 1, True), (2, 2, 5, 6, 7, 8, 9, 10, 1, True)]
    assert prefix_trie._nodes(spark.createDataFrame(same, schema)).count() == 1
    other = [*same, (3, 2, 5, 6, 7, 8, 9, 11, 1, True)]
    with pytest.raises(prefix_trie.Collision):
        prefix_trie._nodes(spark.createDataFrame(other, schema))
