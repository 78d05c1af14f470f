"""Shared helpers: tables, folds, written intermediates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import run_dir

#: One word of the contracts: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key gets fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, so that only a few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def training_labels(labels: DataFrame, key: str, label: str, folds: int, most: int) -> DataFrame:
    """At most about ``most`` labelled keys outside fold 0, as (``key``, ``label``): one row per key.

    Above ``most`` rows a hash of the key picks them, so the pick depends on nothing else. Null keys and null labels
    teach nothing; a key with several labels counts with its largest.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key), folds) != 0))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias(label))
    total = known.count()
    if total > most:
        grain = 1 << 30
        known = known.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(grain)) < int(grain * most / total))
    return known


def training_texts(docs: DataFrame, train: DataFrame, key: str, label: str) -> DataFrame:
    """One text of every key in ``train``, as (``key``, ``y``, ``text``), however often ``docs`` repeats the key.

    Of several texts the one with the least hash is taken. Each task keeps one per key before the shuffle. ``train``
    is broadcast; the rows come in no fixed order.
    """
    rows = docs.select(key, text_of().alias("text")).join(F.broadcast(train), key)
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    one = rows.groupBy(key, F.col(label).alias("y")).agg(least)
    return one.select(key, "y", F.col("least.text").alias("text"))
