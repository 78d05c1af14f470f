from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.rounding import fixed, half_even
from lectern.operators import chunking as C
from lectern.sources import files, store


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("n,expected", [(0, 0), (20, 0), (21, 1), (500, 1), (501, 2), (900, 2), (901, 3)])
def test_chunk_edges(spark, n, expected):
    docs = spark.createDataFrame([("s", " ".join(f"w{i}" for i in range(n)))], "source string, text string")
    chunks = C.chunk_documents(docs, ["source"]).orderBy("chunk_no").collect()
    assert len(chunks) == expected
    for c in chunks:
        assert c["text"].split()[0] == f"w{c['chunk_no'] * 400}"
        assert len(c["text"].split()) == c["n_words"]


def test_tokens_unicode(spark):
    assert one(spark, T.tokens(F.col("t")), t="Été_1 naïve-ÜBER x²!") == ["été_1", "naïve", "über", "x²"]


def test_sentences_and_paragraphs(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three?four . Five ") == ["One.", "Two!", "Three?four .", "Five"]
    assert one(spark, T.paragraphs(F.col("t")), t="a\n\n\n b \n\n \n\nc") == ["a", "b", "c"]


def test_collapse(spark):
    odd = "  a b  c\n d\t\te\u00a0f \u2003g\x1ch \n"
    assert one(spark, T.collapse(F.col("t")), t=odd) == "a b c d e f g h"
    assert one(spark, T.sentences(F.col("t")), t=" \n ") == []


def test_title_case(spark):
    assert one(spark, T.title_case(F.col("t")), t="c++-lang 3d o'neil") == "C++-Lang 3D O'Neil"


def test_clip(spark):
    assert one(spark, T.clip(F.col("t"), 10), t="0123456789") == "0123456789"
    assert one(spark, T.clip(F.col("t"), 10), t="0123456789x") == "0123456..."


def test_decode_and_control(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9\xc3"),)], "c binary")
    assert raw.select(files.decode_text(F.col("c"))).first()[0] == "abé"
    odd = spark.createDataFrame([(bytearray(b"\x00a\tb\x0b\nc\xe9\x1f"),)], "c binary")
    assert odd.select(T.strip_control(F.col("c"))).first()[0] == "a\tb\ncé"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_half_even_property(spark, values):
    ties = [v + d for v in (7, 8, -3) for d in (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.125, 0.375, 0.625)]
    values = values + ties
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    x = F.col("x")
    rows = frame.select("x", half_even(x, 1).alias("a"), half_even(x, 2).alias("b"), fixed(x, 2).alias("t")).collect()
    for r in rows:
        assert r["a"] == round(r["x"], 1) and r["b"] == round(r["x"], 2)
        assert float(r["t"]) == float(f"{r['x']:.2f}")


def test_blank_rejection(spark):
    docs = spark.createDataFrame([("a", " \t \n"), ("b", "x"), ("c", None)], "source string, text string")
    good, bad = files.split_blank(docs)
    assert [r["source"] for r in good.collect()] == ["b"]
    assert sorted(r["source"] for r in bad.collect()) == ["a", "c"]


def test_seeds_make_chunks(spark):
    chunks = C.chunk_documents(files.seed_documents(spark), ["source"])
    assert {r["source"] for r in C.source_counts(chunks).collect()} == {"data_science_fundamentals.txt", "overfitting_guide.txt"}


def test_upload_dedup_looks_at_previous_only(spark):
    ups = [(1, 1, "a", 5), (1, 2, "a", 5), (1, 3, "b", 5), (1, 4, "a", 5), (1, 5, "a", 6), (2, 6, "a", 6)]
    frame = spark.createDataFrame(ups, "s int, o int, name string, size int")
    for width in (1, 2, 100):
        kept = files.skip_repeats(frame, "s", ["o"], "name", "size", F.floor(F.col("o") / width))
        assert sorted(r["o"] for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_latest_text_wins(spark):
    rows = [("a", "old", datetime(2024, 1, 1)), ("a", "new", datetime(2024, 1, 2)), ("b", "x", datetime(2024, 1, 1))]
    docs = spark.createDataFrame(rows, "source string, text string, ingest_ts timestamp")
    assert {r["source"]: r["text"] for r in store.latest_text(docs).collect()} == {"a": "new", "b": "x"}


def test_file_kinds(spark):
    names = ["a.pdf", "a.txt", "a.md", "My Guide", "t.csv", "z"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = frame.select(files.file_kind(F.col("n")), files.file_kind(F.col("n"), True)).collect()
    assert [r[0] for r in got] == ["📄", "📝", "📝", "📘", "📁", "📁"]
    assert [r[1] for r in got] == ["📄", "📝", "📝", "📁", "📊", "📁"]
