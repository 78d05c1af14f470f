"""Overlapping-window chunks of documents (TXT-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Window length, overlap and the word count a chunk must exceed.
CHUNK_SIZE = 500
OVERLAP = 100
MIN_WORDS = 20


def chunk_documents(
    docs: DataFrame,
    keys: list[str],
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per window: ``keys``, ``chunk_no``, ``n_words``, ``text``.

    Narrow work, no shuffle. The windows are cut while the word array is still in its row, so the exploded
    rows carry one window each and never the whole document.
    """
    step = size - overlap
    worded = docs.select(*keys, T.words(F.col(text)).alias("_words"))
    n = F.size("_words")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.least(n - i * step, F.lit(size)).alias("n_words"),
            F.array_join(F.slice("_words", i * step + 1, F.lit(size)), " ").alias("text"),
        ),
    )
    return (
        worded.select(*keys, F.posexplode(windows).alias("chunk_no", "_w"))
        .select(*keys, "chunk_no", F.col("_w.n_words").alias("n_words"), F.col("_w.text").alias("text"))
        .filter(F.col("n_words") > min_words)
    )


def source_counts(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Chunks per source (RET-7). Partial counts are combined before the shuffle, so a hot source is cheap."""
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks")).orderBy(source)


def total_chunks(chunks: DataFrame) -> DataFrame:
    """Size of the whole store (RET-8)."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
