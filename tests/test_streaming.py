import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.session import run_dir
from lectern.sources import files, store
from lectern.streaming import ingest


def test_stream_equals_batch_and_continues(spark, sf):
    """Files that arrive later are picked up by a second run from the same checkpoint, nothing twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inbox, out, progress = (run_dir(spark, n) for n in ("inbox", "chunks", "progress"))
    for part in range(2):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(inbox)
        stream = ingest.read_documents(spark, inbox, docs.schema, files_per_batch=1)
        ingest.ingest_chunks(stream, ["doc_id", "source"], out, progress).awaitTermination()
    got = sorted(map(tuple, store.read_chunks(spark, out).collect()))
    want = sorted(map(tuple, C.chunk_documents(docs, ["doc_id", "source"]).collect()))
    assert got == want


def test_reupload_duplicates_chunks(spark):
    docs = files.seed_documents(spark)
    out = run_dir(spark, "store")
    for _ in range(2):
        store.append_chunks(docs, out, ["source"])
    assert {r["chunks"] for r in C.source_counts(store.read_chunks(spark, out)).collect()} == {2}


def test_stream_drops_repeats(spark):
    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=i), f"f{i % 4}", i % 2) for i in range(40)]
    inbox, out, progress = (run_dir(spark, n) for n in ("inbox", "fresh", "progress"))
    frame = spark.createDataFrame(rows, "ts timestamp, name string, size int")
    frame.write.parquet(inbox)
    stream = ingest.read_documents(spark, inbox, frame.schema)
    ingest.write_rows(ingest.drop_repeats(stream, "ts", ["name", "size"], "1 day"), out, progress).awaitTermination()
    got = spark.read.parquet(out).select("name", "size")
    assert got.count() == 4 and got.distinct().count() == 4


def test_text_files_round_trip(spark):
    out = run_dir(spark, "texts")
    spark.createDataFrame([("naïve text",)], "value string").coalesce(1).write.text(out)
    row = files.load_text(spark, f"{out}/*.txt").first()
    assert row["text"] == "naïve text\n" and row["source"].endswith(".txt")


def test_csv_schema_and_inference(spark):
    out = run_dir(spark, "csv")
    spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string").write.option("header", True).csv(out)
    assert dict(files.load_table(spark, out).dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert dict(files.load_table(spark, out, "a long, b string, c string").dtypes)["b"] == "string"


def test_state_expires_with_the_watermark(spark, tmp_path):
    """A repeat inside the delay is dropped, also in a later batch; one long after it counts as new."""
    days = [
        [("a", "2024-01-01"), ("b", "2024-01-01"), ("a", "2024-01-01")],
        [("a", "2024-01-02"), ("c", "2024-01-10")],
        [("d", "2024-01-11")],
        [("a", "2024-01-11"), ("c", "2024-01-11")],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "name string, ts timestamp"
    for i, rows in enumerate(days):
        part = spark.createDataFrame(rows, "name string, day string").selectExpr("name", "cast(day as timestamp) as ts")
        part.toPandas().to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = ingest.read_documents(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_batch=1)
    fresh = ingest.drop_repeats(stream, "ts", ["name"], "2 days")
    query = ingest.write_rows(fresh, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("name", "cast(ts as date) as day").collect()
    assert sorted((r["name"], str(r["day"])) for r in got) == [
        ("a", "2024-01-01"), ("a", "2024-01-11"), ("b", "2024-01-01"), ("c", "2024-01-10"), ("d", "2024-01-11"),
    ]
    kept = query.lastProgress["stateOperators"][0]
    assert kept["numRowsTotal"] <= 3 and "rocksdb" in str(kept["customMetrics"]).lower()


def test_previous_upload_over_batches(spark, tmp_path):
    """Over ordered batches the stream keeps what one look back keeps; late rows pass and change nothing."""
    days = [
        [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 1, None)],
        [("u", 4, "b"), ("u", 5, "a"), ("v", 2, None), ("w", 1, "x")],
        [("u", 4, "late"), ("u", 6, "a"), ("u", 7, "c"), ("w", 2, "x")],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(days):
        part = spark.createDataFrame(rows, "who string, day int, name string").selectExpr(
            "who", "cast(date_add(date'2024-01-01', day) as timestamp) as ts", "day", "name", "1 as size"
        )
        part.toPandas().to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.createDataFrame([], "who string, ts timestamp, day int, name string, size int").schema
    stream = ingest.read_documents(spark, str(folder), schema, files_per_batch=1)
    fresh = ingest.skip_repeats(stream, "who", "ts", ["day"], "name", "size", delay="30 days")
    ingest.write_rows(fresh, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("who", "day", "name").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("u", 1, "a"), ("u", 3, "b"), ("v", 1, None), ("u", 5, "a"), ("w", 1, "x"), ("u", 4, "late"), ("u", 7, "c"),
    ], key=str)


def test_text_store_takes_replays_and_snapshots(spark, tmp_path):
    from lectern.sources.store import TextStore

    store = TextStore(spark, str(tmp_path / "s"), order="at")
    assert store.read() is None
    store.compact()

    def rows(*items):
        return spark.createDataFrame(items, "source string, text string, at long")

    def texts():
        return {r["source"]: (r["text"], r["at"]) for r in store.read().collect()}

    first, second = rows(("a", "one", 1), ("b", "two", 1), (None, "none", 1)), rows(("a", "three", 2), ("c", "four", 0))
    store.upsert(first, 0)
    store.upsert(second, 1)
    want = {"a": ("three", 2), "b": ("two", 1), "c": ("four", 0), None: ("none", 1)}
    assert texts() == want
    store.upsert(first, 0)
    assert texts() == want
    store.compact()
    store.compact()
    assert texts() == want
    store.upsert(first, 0)  # behind the snapshot already
    assert texts() == want
    store.upsert(rows(("b", "five", 3), ("a", "old", 0)), 2)
    assert texts() == want | {"b": ("five", 3)}
    store.compact()
    assert texts() == want | {"b": ("five", 3)}
