"""Text and table sources (SRC-1…4, SRC-7…9, TXT-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import text as T

# File kinds by name, main and retrieval-only listing.
KIND_PDF, KIND_TEXT, KIND_GUIDE, KIND_TABLE, KIND_OTHER = "📄", "📝", "📘", "📊", "📁"


def decode_text(content: Column) -> Column:
    """UTF-8 text of raw bytes with bad bytes dropped (SRC-1)."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents ``source, folder, text, length``; every kind is read as raw text (SRC-1)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("source"),
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"),
        decode_text(F.col("content")).alias("text"),
        "length",
    )


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; types are inferred unless a schema is given (SRC-2). A schema saves one pass."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def seed_documents(spark: SparkSession) -> DataFrame:
    """The two built-in guides (SRC-3)."""
    return spark.createDataFrame(V.SEED_DOCUMENTS, "source string, text string")


def with_seeds(documents: DataFrame) -> DataFrame:
    return seed_documents(documents.sparkSession).unionByName(documents, allowMissingColumns=True)


def split_blank(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents; whitespace-only text is rejected with a reason (SRC-4)."""
    blank = T.is_blank(F.col(text))
    rejected = documents.filter(blank).withColumn("reason", F.lit("Uploaded file is empty or unsupported."))
    return documents.filter(~blank), rejected


def skip_repeats(uploads: DataFrame, session: str, order: list[str], name: str, size: str, bucket: Column) -> DataFrame:
    """Uploads whose name and size differ from the session's previous upload (SRC-7).

    ``bucket`` is a non-decreasing function of the order (an hour, a day). Rows look back inside their bucket;
    a bucket's first row looks at the last row of the bucket before. A session that
    holds a third of all uploads is thus split over its buckets.
    """
    marked = uploads.withColumn("_b", bucket).withColumn(
        "_mark", F.concat_ws("_", F.col(name).cast("string"), F.col(size).cast("string"))
    )
    inside = Window.partitionBy(session, "_b").orderBy(*order)
    seen = marked.withColumn("_prev", F.lag("_mark").over(inside)).withColumn("_next", F.lead("_mark").over(inside))
    fresh = ~F.col("_mark").eqNullSafe(F.col("_prev"))
    inner = seen.filter(F.col("_prev").isNotNull() & fresh)
    # First and last rows of the buckets alone, in order: a first row follows the last row of the bucket before.
    edges = seen.filter(F.col("_prev").isNull() | F.col("_next").isNull()).withColumn("_first", F.col("_prev").isNull())
    over = Window.partitionBy(session).orderBy("_b", *order)
    firsts = edges.withColumn("_prev", F.lag("_mark").over(over)).filter(F.col("_first") & fresh)
    return inner.select(*uploads.columns).unionByName(firsts.select(*uploads.columns))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First rows by a key (SRC-8); a distributed table has no file order."""
    return df.orderBy(*order).limit(n)


def file_kind(name: Column, grounded: bool = False) -> Column:
    """Icon of a file by its name (SRC-9). The retrieval-only listing knows tables, the main one guides."""
    third = (
        (F.endswith(name, F.lit(".csv")), KIND_TABLE) if grounded else (F.contains(name, F.lit("Guide")), KIND_GUIDE)
    )
    return (
        F.when(F.endswith(name, F.lit(".pdf")), F.lit(KIND_PDF))
        .when(F.endswith(name, F.lit(".txt")) | F.endswith(name, F.lit(".md")), F.lit(KIND_TEXT))
        .when(third[0], F.lit(third[1]))
        .otherwise(F.lit(KIND_OTHER))
    )
