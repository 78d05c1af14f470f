"""Repeated strings against a dictionary of all of them; the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lectern.llm import suffixes
from lectern.llm.grouping import suffix_array


def expected(texts):
    length = suffixes.LENGTH
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            p = list(p[a : a + rng.randint(100, 700)])
            for _ in range(rng.choice([0, 0, 1, 3])):
                p[rng.randrange(len(p))] = rng.choice("xyzé")
            parts += ["".join(p), word()]
        texts.append(" ".join(parts))
    texts += [None, "", "a" * 199, "a" * 200, "b" * 201, "ab" * 300, "short", texts[0], texts[0], texts[1] + "!"]
    texts += ["word " * 3000, passages[0][:199], passages[0][:200], "é" * 150]
    return texts


@pytest.mark.parametrize(("seed", "chunk"), [(1, 8 << 20), (2, 3000), (3, 20_000)])
def test_against_all_strings(make, seed, chunk, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    texts = corpus(seed)
    ids = [i if i % 13 else None for i in range(len(texts))]
    got = sorted((str(r[0]), *r[1:]) for r in suffixes.op8(make(list(zip(ids, texts)))).collect())
    assert got == sorted((str(i), *e) for i, e in zip(ids, expected(texts)))


def test_many_buckets_against_all_strings(make, monkeypatch):
    """Far more buckets than a chunk has contexts: rows go only to those that its contexts fall into."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 16)
    monkeypatch.setattr(suffixes, "BUCKETS_PER_TASK", 256)
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", 3)
    texts = corpus(6) + hot_corpus(11, 40, 150)
    got = sorted((str(r[0]), *r[1:]) for r in suffixes.op8(make(list(enumerate(texts)))).collect())
    assert got == sorted((str(i), *e) for i, e in enumerate(expected(texts)))
    task = type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)})
    monkeypatch.setattr(suffixes, "TaskContext", task)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 1 << 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None], "text": [texts[0], ""]})
    rows = pa.Table.from_batches(suffixes._asked(1 << 31)([batch]))
    assert rows["bucket"][0].as_py() == -1 and 1 < len(rows) <= len(texts[0].encode())


def test_anchors_fill_the_buckets_alike():
    """An anchor is the least hash of many; its bucket must not follow from that."""
    rng = random.Random(8)
    data = bytes(rng.choices(range(97, 123), k=400_000))
    grams = np.unique(suffixes.anchors(data, suffixes._Powers())[0])
    sizes = np.bincount(suffixes.bucket_of(grams, 64, 16).astype(int), minlength=16)
    assert sizes.min() > 0.8 * len(grams) / 16 and sizes.max() < 1.2 * len(grams) / 16


def test_long_texts_in_segments(monkeypatch):
    data = (corpus(4)[0] * 20).encode()
    powers = suffixes._Powers()
    whole = suffixes.anchors(data, powers)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    parts = suffixes.anchors(data, powers)
    for _, place, first, last in (whole, parts):
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        assert (covered == np.arange(len(data) - suffixes.LENGTH + 1)).all()
        assert (place >= last).all() and (place + suffixes.GRAM <= first + suffixes.LENGTH).all()
    owner = [np.repeat(x[1], x[3] - x[2] + 1) for x in (whole, parts)]
    assert (owner[0] == owner[1]).all()


def test_empty_table(make):
    assert suffixes.op8(make([(1, "a")]).limit(0)).collect() == []


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            s = s + s[: len(s) // 2] + s
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def hot_corpus(seed, documents, line_bytes):
    """One line in every document, other text around it; a few documents share more than the line."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = text(line_bytes)
    texts = [text(rng.randint(0, 300)) + line + text(rng.randint(0, 300)) for _ in range(documents)]
    shared = [text(rng.randint(1, 150)) + line + text(rng.randint(1, 150)) for _ in range(5)]
    return texts + [text(9) + rng.choice(shared) + text(9) for _ in range(20)] + texts[:3]


@pytest.mark.parametrize(("line_bytes", "chunk"), [(60, 4000), (190, 8 << 20), (190, 4000), (230, 4000)])
def test_hot_anchors_against_all_strings(make, line_bytes, chunk, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", 3)
    texts = hot_corpus(line_bytes, 80, line_bytes) + corpus(5)
    got = sorted((str(r[0]), *r[1:]) for r in suffixes.op8(make(list(enumerate(texts)))).collect())
    assert got == sorted((str(i), *e) for i, e in enumerate(expected(texts)))


@pytest.mark.parametrize("line_bytes", [100, 199])
def test_a_hot_anchor_is_not_sorted_in_one_place(line_bytes, monkeypatch):
    texts = hot_corpus(7, 9000, line_bytes)
    sorted_bytes, whole = [], suffixes.repeated_starts

    def watched(body, *args):
        sorted_bytes.append(len(body))
        return whole(body, *args)

    def grouped(tables, key):
        rows = pa.concat_tables(tables)
        for k in sorted(set(rows[key].to_pylist())):
            yield rows.filter(pc.equal(rows[key], k))

    task = type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)})
    monkeypatch.setattr(suffixes, "TaskContext", task)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 1 << 20)
    monkeypatch.setattr(suffixes, "repeated_starts", watched)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tables = [pa.Table.from_batches(suffixes._asked(4)([batch]))]
    for key, step in (("bucket", "_answer"), ("chunk", "_opened"), ("bucket", "_compared"), ("chunk", "_dropped")):
        tables = [getattr(suffixes, step)(group) for group in grouped(tables, key)]
    got = pa.concat_tables(tables).sort_by("doc_id")
    kept = [hashlib.sha256(k).hexdigest() for k in got["kept"].to_pylist()]
    assert list(zip(got["n_bytes"].to_pylist(), got["n_removed"].to_pylist(), got["n_spans"].to_pylist(), kept)) == expected(texts)
    assert max(sorted_bytes, default=0) < 2 * suffixes.SORTED_BYTES
