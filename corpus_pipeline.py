"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before kept, is written as Parquet and read again, so a lost executor or a new
run never repeats more than one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, jaccard, mixing, pii, quality
from lectern.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns its words from all documents of the stage."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, COLUMNS)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each personal span replaced by its kind and ``n_chars`` counted anew."""
    clean = pii.redact(pii.find_pii(docs.select(*COLUMNS)))
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Trained scores, minhashes, edit distances and seeded draws are not SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
