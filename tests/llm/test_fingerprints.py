"""Fingerprints: edited texts by hand, the algebra of the multiset hash."""

import hashlib

from pyspark.sql import functions as F

from lectern.llm import fingerprints as fp


def expected(rows):
    """doc_id -> sha256 of the edited text, for rows with different ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        out[i] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    return out


def test_edited_texts(make, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 7)
    rows = [(i * 3 - 50, f"line {i}.\n" * (i % 9) + "é😀" * (i % 4)) for i in range(200)] + [(9999, None), (9998, "")]
    got = {r["doc_id"]: r for r in fp.op4(make(rows)).collect()}
    assert {i: r["edited_sha256"] for i, r in got.items()} == expected(rows)
    assert {i: r["n_chars"] for i, r in got.items()} == {i: len(t or "") for i, t in rows}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_ties_nulls_and_small_tables(make, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 2)
    rows = [(5, "b one"), (5, "a two"), (5, "a two"), (None, "n"), (None, None), (7, "top")]
    got = fp.op4(make(rows)).collect()
    assert len(got) == 6
    assert [r["fingerprint"] for r in got if r["n_chars"] == 5].count(got[0]["fingerprint"]) in (0, 1, 2)
    one = fp.op4(make([(3, "alone here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert len(fp.op4(make([(None, "x y"), (None, "z")])).collect()) == 2
    assert fp.op4(make([(1, "a")]).limit(0)).collect() == []


def test_equal_texts_and_order(make):
    rows = [(1, "a b.\nc d.\ne"), (2, "a b.\nc d.\ne"), (3, "e\nc d.\na b."), (4, "a b.\nc d.\nf")]
    got = {r["doc_id"]: r["fingerprint"] for r in fp.op4(make(rows)).collect()}
    assert got[1] == got[2] == got[3] != got[4]


def test_insert_and_delete(spark):
    whole, start, end = "p one.\np two.\np three.\np two.", "p one.\np three.", "p two.\np two."
    v = fp.vector
    row = spark.range(1).select(
        fp.shown(v(F.lit(whole))).alias("whole"),
        fp.shown(fp.insert(v(F.lit(start)), v(F.lit(end)))).alias("added"),
        fp.shown(v(F.lit(start))).alias("start"),
        fp.shown(fp.delete(v(F.lit(whole)), v(F.lit(end)))).alias("left"),
    ).first()
    assert row["whole"] == row["added"] and row["start"] == row["left"]


def test_likeness_follows_the_shared_part(make):
    lines = [f"paragraph number {i} of the text." for i in range(400)]
    rows = [(2, "\n".join(lines)), (1, "\n".join(f"other {i} words." for i in range(400)))]
    got = {r["doc_id"]: r for r in fp.op4(make(rows)).collect()}
    assert 0.25 < got[2]["near_edited"] < 0.75 and got[2]["near_next"] < 0.45


def test_blanks_around_a_paragraph_do_not_count(make):
    rows = [(1, "12 a b. 3 c\n5 d"), (2, "  12 a b.   3 c \n\n 5 d  ")]
    got = {r["doc_id"]: r["fingerprint"] for r in fp.op4(make(rows)).collect()}
    assert got[1] == got[2]
