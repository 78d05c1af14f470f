"""Incremental forms of ingest, text upsert and upload de-duplication (SRC-5, SRC-6, SRC-7).

All run as Structured Streaming jobs with a checkpoint in the shared folder, so a lost executor or a
restarted driver continues where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import text as T
from lectern.operators.chunking import chunk_documents
from lectern.sources.store import TextStore


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files under a path or glob as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_chunks(documents: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of all documents that arrived; stateless, so it scales with the files (SRC-5)."""
    accepted = documents.filter(~T.is_blank(F.col("text")))
    return (
        chunk_documents(accepted, keys)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_repeats(uploads: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """First upload per fingerprint within the watermark (SRC-7).

    Stronger than comparing with the previous upload only: any repeat inside the delay is dropped. State holds
    one entry per fingerprint and expires with the watermark.
    """
    return uploads.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def skip_repeats(
    uploads: DataFrame, session: str, ts: str, ties: list[str], name: str, size: str, delay: str = "1 day",
    expiry: str = "30 days",
) -> DataFrame:
    """Uploads whose name and size differ from the session's previous upload, over all micro-batches (SRC-7).

    State is one row per session: its last upload. The uploads of a micro-batch are compared in the order of ``ts`` and
    ``ties``, the first one with the state. A late row, older than the last one its session had in an earlier batch,
    passes unchecked and changes nothing, so no upload is lost. The state of a session that was silent for ``expiry``
    behind the watermark is removed; its next upload counts as new. Rows whose ``ts`` is null belong first.
    """
    order, schema = [ts, *ties], uploads.schema
    marked = uploads.withColumn("_mark", F.concat_ws("_", F.col(name).cast("string"), F.col(size).cast("string")))
    marked = marked.withWatermark(ts, delay)
    kept_for = int(pd.Timedelta(expiry).total_seconds() * 1000)
    state_schema = StructType([*[schema[c] for c in order], StructField("_mark", StringType())])

    def compare(key, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable", na_position="first")
        *last, mark = state.get if state.exists else (*[None] * len(order), None)
        if state.exists:
            # Nulls stand before everything.
            known = [tuple((v is not None and v == v, v if v == v else None) for v in r) for r in rows[order].itertuples(index=False)]
            seen = tuple((v is not None, pd.Timestamp(v) if i == 0 and v is not None else v) for i, v in enumerate(last))
            late = pd.Series([k <= seen for k in known], index=rows.index, dtype=bool)
        else:
            late = pd.Series(False, index=rows.index)
        if late.any():
            yield rows[late.to_numpy()].drop(columns="_mark")
        rows = rows[~late.to_numpy()]
        if len(rows):
            before = rows["_mark"].shift(1)
            fresh = rows["_mark"] != before
            fresh.iloc[0] = mark is None or rows["_mark"].iloc[0] != mark
            if fresh.any():
                yield rows[fresh.to_numpy()].drop(columns="_mark")
            end = rows.iloc[-1]
            state.update(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in end[[*order, "_mark"]]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + kept_for)

    return marked.groupBy(session).applyInPandasWithState(
        compare, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def upsert_texts(documents: DataFrame, store: TextStore, checkpoint: str, first: int = 0) -> StreamingQuery:
    """Every micro-batch into the text store under its own number, so a batch that is run again adds nothing (SRC-6).

    ``first`` is the number of the stream's first batch, for a store that others wrote to before.
    """
    return (
        documents.writeStream.foreachBatch(lambda rows, number: store.upsert(rows, first + number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_rows(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder. State is kept in RocksDB, unless the session names a store, so that it may
    outgrow the executors' memory."""
    conf = rows.sparkSession.conf
    if conf.get(STATE_STORE).endswith("HDFSBackedStateStoreProvider"):
        conf.set(STATE_STORE, ROCKSDB)
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
