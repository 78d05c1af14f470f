"""A stored token index over chunks: written once, appended to, searched without the texts (RET-1, SRC-5).

Each segment is what one append brought: the chunks, each with a number of its own, the postings (token, chunk number,
number of tokens) and the vocabulary with its document counts. A search meets the vocabulary first, then the postings
of the tokens it needs, and reads chunks only for what it found. An append writes a segment of its own and leaves the
others alone; a segment that is written again under its name is replaced, so a replay adds nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.binding import once

TOKENS, SIZE = "_d", "_nd"
#: Name a stored row: the segment and the row's number in it.
ROW = ["_part", "_row"]


class TermIndex:
    """The index in a folder that all executors share.

    ``keys`` name a chunk; they may repeat or be null, since the index tells its rows apart by ``ROW``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], text: str = "text"):
        self.spark, self.path, self.keys, self.text = spark, path, keys, text

    def add(self, chunks: DataFrame, segment: str) -> TermIndex:
        """Writes the chunks as ``segment`` and tokenises them once; an earlier one of that name is replaced."""
        at = {part: os.path.join(self.path, part, f"segment={segment}") for part in ("chunks", "postings", "vocabulary")}
        rows = chunks.withColumns({"_part": F.lit(segment), "_row": F.monotonically_increasing_id()})
        rows.write.mode("overwrite").parquet(at["chunks"])
        # The numbers hold once they are written, so the postings are made from the stored chunks.
        stored = self.spark.read.schema(rows.schema).parquet(at["chunks"])
        tokens = stored.select(*ROW, T.distinct_tokens(F.col(self.text)).alias(TOKENS))
        postings = tokens.select(F.explode(once(F.col(TOKENS))).alias("token"), *ROW, F.size(TOKENS).alias(SIZE))
        postings.write.mode("overwrite").parquet(at["postings"])
        counts = self.spark.read.schema(postings.schema).parquet(at["postings"]).groupBy("token")
        counts.agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(at["vocabulary"])
        return self

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, part)).drop("segment")

    def chunks(self) -> DataFrame:
        """The chunks as they were added, with their ``ROW``."""
        return self._read("chunks")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def vocabulary(self) -> DataFrame:
        """Each token with the number of chunks that hold it, over all segments."""
        return self._read("vocabulary").groupBy("token").agg(F.sum("df").alias("df"))
