"""Chunk store and text store on Parquet (SRC-5, SRC-6)."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.bounded import broadcast_if_small
from lectern.operators.chunking import chunk_documents


def append_chunks(documents: DataFrame, path: str, keys: list[str]) -> None:
    """Chunk documents and append them; a document added twice is stored twice (SRC-5)."""
    chunk_documents(documents, keys).write.mode("append").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_text(documents: DataFrame, source: str = "source", text: str = "text", order: str = "ingest_ts") -> DataFrame:
    """Last text per source (SRC-6), of several with the last order the largest text; a null source is a source.

    The last order of each source is found without its texts; only the texts that have it are read on.
    """
    last = documents.groupBy(F.col(source).alias("_source")).agg(F.max(order).alias("_last"))
    same = F.col(source).eqNullSafe(F.col("_source")) & F.col(order).eqNullSafe(F.col("_last"))
    found = documents.select(source, text, order).join(broadcast_if_small(last), same)
    return found.groupBy(source).agg(F.max(text).alias(text), F.max(order).alias(order))


class TextStore:
    """Last text per source in a shared folder, fed by numbered batches (SRC-6).

    A batch is written as a delta of its own, with one row per source; written again it replaces itself, so a replay
    changes nothing. A snapshot holds the last texts of all batches up to a number; a reader takes the newest snapshot
    and the deltas behind it. A snapshot becomes visible when it is complete, and older files are left alone.
    """

    def __init__(self, spark: SparkSession, path: str, source: str = "source", text: str = "text", order: str = "ingest_ts"):
        self.spark, self.path, self.columns = spark, path, (source, text, order)

    def upsert(self, rows: DataFrame, batch: int) -> None:
        latest_text(rows, *self.columns).write.mode("overwrite").parquet(os.path.join(self.path, "deltas", f"batch={batch}"))

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(os.path.join(self.path, part))
        except AnalysisException as err:
            if err.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _snapshot(self) -> int | None:
        """The number of the newest snapshot: numbers are written to a list after their snapshot is complete."""
        listed = self._read("complete")
        return None if listed is None else listed.selectExpr("max(upto) AS upto").first()["upto"]

    def read(self) -> DataFrame | None:
        """The last text of every source; None when nothing was ever written."""
        upto, deltas = self._snapshot(), self._read("deltas")
        parts = [] if upto is None else [self.spark.read.parquet(os.path.join(self.path, "snapshots", f"upto={upto}"))]
        if deltas is not None:
            later = deltas if upto is None else deltas.filter(F.col("batch") > upto)
            parts.append(later.select(*self.columns))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return latest_text(rows, *self.columns)

    def compact(self) -> None:
        """A new snapshot of everything written so far."""
        rows, deltas = self.read(), self._read("deltas")
        if rows is None or deltas is None:
            return
        upto = max(deltas.selectExpr("max(batch) AS b").first()["b"], self._snapshot() or 0)
        if upto == self._snapshot():
            return
        rows.write.mode("overwrite").parquet(os.path.join(self.path, "snapshots", f"upto={upto}"))
        done = self.spark.createDataFrame([(upto,)], "upto long")
        done.coalesce(1).write.mode("append").parquet(os.path.join(self.path, "complete"))
