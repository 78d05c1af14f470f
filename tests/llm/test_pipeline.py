"""The pipeline: each stage on all that the one before kept, its decisions in effect, nothing else lost."""

import random
import re

import pytest

import corpus_pipeline as cp
from lectern.llm import decontamination as dc

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of which it is known what each stage has to do with them."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    items = [(i, prose(25)) for i in range(5)]
    texts, bad, leaks = [], set(), set()
    for i in range(300):
        kind = i % 10
        text = prose(rng.randint(60, 120))
        if kind == 7:
            text = " ".join(w.upper() + "!!" for w in text.split())
            bad.add(i)
        elif kind == 8:
            text = text + " " + items[i % 5][1] + " " + prose(20)
            leaks.add(i)
        elif kind == 9 and texts[i - 3] is not None:
            head = texts[i - 3].split()
            text = " ".join([*head[:-1], "changed"])
        elif kind == 4:
            text += " write to jo.do@mail.example.com or +1 202 555 0143 now"
        texts.append(text)
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(80), None, None, None), (500, None, "en", "s1", None), (501, "", "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int(i not in bad), 0) for i in range(300) if i % 10 in (0, 1, 2, 4, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, bad, leaks


def ran(spark, d):
    """The rows after every stage."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, d)
        if name != "mixing":
            assert docs.columns == cp.COLUMNS
            assert docs.schema == spark.read.parquet(f"{d}/documents.parquet").schema
            docs = cp.written(docs, f"test-{name}")
        out.append(docs.collect())
    return out


def test_stages(spark, small):
    d, bad, leaks = small
    start, good, unique, clean, redacted, mixed = ran(spark, d)
    ids = [{r["doc_id"] for r in rows} for rows in (start, good, unique, clean, redacted, mixed)]
    assert {i for i in ids[0] if i in bad} & ids[1] == set()
    assert {i for i in range(300) if i not in bad} <= ids[1]  # clean documents stay

    # Near-duplicates, by brute force: the least id of each linked group of what came in.
    known = sorted((r for r in good if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    sets = [shingles(r["text"] or "") for r in known]
    label = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) * 5 >= 4 * len(a | b)):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert ids[2] - {None} == {known[i]["doc_id"] for i in set(label)}

    items = [dc.normal(r["text"]).strip() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaky = {r["doc_id"] for r in unique if any(i in dc.normal(r["text"] or "") for i in items)}
    assert leaky == leaks & ids[2] and ids[3] == ids[2] - leaky
    assert ids[4] == ids[3] and len(redacted) == len(clean)
    for r in redacted:
        assert not re.search(r"@mail|\+1 202", r["text"] or "")
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    marks = [r for r in redacted if r["doc_id"] is not None and r["doc_id"] % 10 == 4 and r["doc_id"] < 300]
    assert marks and all("<EMAIL>" in r["text"] and "<PHONE>" in r["text"] for r in marks)
    assert len(mixed) == len(redacted)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in redacted}
    assert {r["doc_id"]: r["size"] for r in mixed} == sizes


def test_run_gives_the_last_stage(spark, small):
    d = small[0]
    got = sorted(map(str, cp.run(spark, d).collect()))
    assert got == sorted(map(str, ran(spark, d)[-1]))


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, schema in (
        ("documents", DOCUMENTS), ("benchmark", "item_id long, text string"),
        ("labels", "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    assert cp.run(spark, d).collect() == []
