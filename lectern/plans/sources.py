"""Queries for sources, stores and streams (SRC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table
from lectern.session import run_dir
from lectern.sources import files, store
from lectern.streaming import ingest


@query(
    "SRC-1 TXT-7",
    """SELECT doc_id, text AS decoded, 'a b' || doc_id || chr(10) AS latin FROM documents""",
)
def decoded_uploads(spark, sf_dir):
    """Documents as raw bytes with bad bytes and control characters put in, decoded again."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = docs.select(
        "doc_id",
        F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3"))).alias("content"),
        F.encode(F.concat(F.lit("a\u0001 b\u000b\u001f"), F.col("doc_id").cast("string"), F.lit("\n")), "UTF-8").alias("odd"),
    )
    return raw.select(
        "doc_id", files.decode_text(F.col("content")).alias("decoded"), T.strip_control(F.col("odd")).alias("latin")
    )


@query(
    "SRC-1 SRC-4",
    """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE line <> '' GROUP BY source""",
)
def text_files(spark, sf_dir):
    """The documents written as text files of at most 100 documents each, loaded again, non-blank ones counted."""
    out = run_dir(spark, "text")
    docs = table(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    docs.write.option("maxRecordsPerFile", 100).partitionBy("source").text(out)
    loaded = files.split_blank(files.load_text(spark, out))[0]
    lines = loaded.select("folder", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "")
    return lines.groupBy(F.regexp_extract("folder", "source=(.+)$", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")
    )


@query(
    "SRC-2",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_table(spark, sf_dir):
    """Customers written as CSV and loaded with inferred types."""
    out = run_dir(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", "true").csv(out)
    loaded = files.load_table(spark, out)
    return loaded.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


_SEEDS = " UNION ALL ".join(
    f"SELECT {S.text(s)} AS source, {S.text(t)} AS text" for s, t in V.SEED_DOCUMENTS
)


@query(
    "SRC-3 SRC-5 RET-7",
    f"""WITH store AS ({_SEEDS} UNION ALL SELECT source, text FROM documents UNION ALL SELECT source, text FROM documents),
    chunks AS ({S.chunks('store', 'source')})
    SELECT source, count(*) AS chunks FROM chunks GROUP BY source""",
)
def chunk_store(spark, sf_dir):
    """Seeds and documents appended to a store, the documents twice: a re-upload duplicates its chunks."""
    out = run_dir(spark, "store")
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    store.append_chunks(files.with_seeds(docs), out, ["source"])
    store.append_chunks(docs, out, ["source"])
    return C.source_counts(store.read_chunks(spark, out))


BLANKED = "CASE doc_id % 10 WHEN 3 THEN ' \t\n' WHEN 7 THEN '' ELSE text END"


@query(
    "SRC-4",
    """SELECT source, count(*) FILTER (doc_id % 10 NOT IN (3, 7)) AS accepted,
         count(*) FILTER (doc_id % 10 IN (3, 7)) AS rejected FROM documents GROUP BY source""",
)
def blank_rejection(spark, sf_dir):
    """Documents with a fifth of the texts blanked, split into accepted and rejected."""
    docs = table(spark, sf_dir, "documents").select("source", F.expr(BLANKED).alias("text"))
    good, bad = files.split_blank(docs)
    marked = good.select("source", F.lit(True).alias("ok")).unionByName(bad.select("source", F.lit(False).alias("ok")))
    return marked.groupBy("source").agg(
        F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected")
    )


@query(
    "SRC-6",
    "SELECT source, arg_max(text, doc_id) AS text, max(doc_id) AS doc_id FROM documents GROUP BY source",
)
def latest_texts(spark, sf_dir):
    """Last text of every source."""
    return store.latest_text(table(spark, sf_dir, "documents"), order="doc_id")


@query(
    "SRC-7",
    """WITH u AS (SELECT event_id, user_id, event_type || '_' || (event_id % 2) AS mark,
                lag(event_type || '_' || (event_id % 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT event_id, user_id FROM u WHERE prev IS NULL OR prev <> mark""",
)
def fresh_uploads(spark, sf_dir):
    """Events as uploads per user: those that do not repeat the user's previous one."""
    uploads = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", (F.col("event_id") % 2).alias("size")
    )
    hour = F.date_trunc("hour", F.col("ts"))
    kept = files.skip_repeats(uploads, "user_id", ["ts", "event_id"], "event_type", "size", hour)
    return kept.select("event_id", "user_id")


@query(
    "SRC-8",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
)
def first_rows(spark, sf_dir):
    return files.preview(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]
    )


NAME_SQL = "CASE page_id % 6 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '.txt' WHEN 2 THEN url || '.md' WHEN 3 THEN 'Guide ' || url WHEN 4 THEN url || '.csv' ELSE url END"


@query(
    "SRC-9",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '📄' WHEN 1 THEN '📝' WHEN 2 THEN '📝' WHEN 3 THEN '📘' ELSE '📁' END AS kind,
       CASE page_id % 6 WHEN 0 THEN '📄' WHEN 1 THEN '📝' WHEN 2 THEN '📝' WHEN 4 THEN '📊' ELSE '📁' END AS listed_kind FROM pages""",
)
def file_kinds(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select("page_id", F.expr(NAME_SQL).alias("name"))
    return names.select(
        "page_id", files.file_kind(F.col("name")).alias("kind"), files.file_kind(F.col("name"), True).alias("listed_kind")
    )


@query(
    "SRC-5 (stream)",
    f"SELECT source, count(*) AS chunks FROM ({S.chunks()}) GROUP BY source",
)
def stream_chunks(spark, sf_dir):
    """The documents ingested as a stream into a chunk store; must equal the batch counts."""
    out, checkpoint = run_dir(spark, "stream"), run_dir(spark, "progress")
    schema = table(spark, sf_dir, "documents").schema
    stream = ingest.read_documents(spark, f"{sf_dir}/documents*.parquet", schema)
    ingest.ingest_chunks(stream.select("doc_id", "source", "text"), ["doc_id", "source"], out, checkpoint).awaitTermination()
    return C.source_counts(store.read_chunks(spark, out))


@query(
    "SRC-7 (stream)",
    "SELECT DISTINCT user_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS INTEGER) AS size FROM events",
)
def stream_fresh_uploads(spark, sf_dir):
    """Events as an upload stream: one row per user, name and size inside a watermark longer than the data."""
    out, checkpoint = run_dir(spark, "uploads"), run_dir(spark, "progress")
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_documents(spark, f"{sf_dir}/events*.parquet", schema)
    uploads = stream.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("size")
    )
    fresh = ingest.drop_repeats(uploads, "ts", ["user_id", "name", "size"], "3650 days")
    ingest.write_rows(fresh, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("user_id", "name", "size")


@query(
    "SRC-7 (stream, previous upload)",
    """WITH u AS (SELECT event_id, user_id, event_type || '_' || (event_id % 2) AS mark,
                lag(event_type || '_' || (event_id % 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT event_id, user_id FROM u WHERE prev IS NULL OR prev <> mark""",
)
def stream_previous_uploads(spark, sf_dir):
    """Events as uploads that arrive in four micro-batches: those that do not repeat their user's previous one."""
    uploads = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        (F.col("event_id") % 2).cast("int").alias("size"),
    )
    seconds = F.unix_micros("ts")
    cuts = uploads.agg(F.percentile_approx(seconds, [0.25, 0.5, 0.75], 1000).alias("c")).first()["c"] or []
    part = sum([(seconds > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    folder = run_dir(spark, "arriving")
    for i in range(len(cuts) + 1):  # one file each, in the order in which they arrive
        uploads.filter(F.coalesce(part, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(folder)
    out, checkpoint = run_dir(spark, "uploads"), run_dir(spark, "progress")
    stream = ingest.read_documents(spark, folder, uploads.schema, 1)
    fresh = ingest.skip_repeats(stream, "user_id", "ts", ["event_id"], "event_type", "size", expiry="3650 days")
    ingest.write_rows(fresh, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id")


@query(
    "SRC-6 (stream)",
    "SELECT source, arg_max(text, doc_id) AS text, max(doc_id) AS doc_id FROM documents GROUP BY source",
)
def stream_latest_texts(spark, sf_dir):
    """Last text of every source from a store fed by a stream, with one batch run twice and a snapshot."""
    docs = table(spark, sf_dir, "documents").select("source", "text", "doc_id")
    texts = store.TextStore(spark, run_dir(spark, "texts"), order="doc_id")
    early = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(True))
    texts.upsert(docs.filter(early), 0)
    texts.upsert(docs.filter(early), 0)
    texts.compact()
    stream = ingest.read_documents(spark, f"{sf_dir}/documents*.parquet", table(spark, sf_dir, "documents").schema)
    rest = stream.select("source", "text", "doc_id").filter(~early)
    ingest.upsert_texts(rest, texts, run_dir(spark, "progress"), 1).awaitTermination()
    return texts.read().select("source", "text", "doc_id")
