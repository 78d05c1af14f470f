"""A stored inverted-file index over vectors: lists around centroids, searched exactly or up to a number of lists (RET-2).

Vectors are compared by cosine, so they are put on the unit sphere. Centroids come from k-means on a bounded sample;
every vector is put in the list of the nearest one, and the files are sorted by list. A list knows its radius, the
largest angle between its centroid and a vector in it. No vector of a list is nearer to a query than the angle between
query and centroid less that radius: this bound decides which lists an exact search may leave out.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.operators.nearest import _matrix, _meeting, _scorer, usable, usual_size

#: Rows that the centroids are learned from, and the most lists there are; the driver holds the centroids.
SAMPLE = 20_000
MAX_LISTS = 4096
#: Rows of a list and queries of a list that one task compares.
PIECE = 16_384
PART = 2048
#: Queries that the number of probes is set by.
TRIED = 200
SEED = 42
#: Rounding of angles must not lose a neighbour.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True)
        y = np.where(top > 0, x / top, 0)
        return np.where(top > 0, y / np.linalg.norm(y, axis=1, keepdims=True), 0)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class VectorIndex:
    """The index in a folder that all executors share. ``key`` names a vector; equal keys are vectors of their own.

    Vectors that are null, zero, hold a null, NaN or infinity, or differ from the usual length are not indexed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, vec: str):
        self.spark, self.path, self.key, self.vec = spark, path, key, vec
        self._centroids: np.ndarray | None = None

    def _at(self, part: str) -> str:
        return os.path.join(self.path, part)

    # ------------------------------------------------------------------------------------------ writing

    def build(self, vectors: DataFrame, lists: int | None = None) -> VectorIndex:
        """Learns the centroids from at most ``SAMPLE`` rows, drawn by hash, and indexes every row.

        ``lists`` is the square root of the number of vectors unless given, ``MAX_LISTS`` at most.
        """
        width = usual_size(vectors, self.vec)
        rows = self._usable(vectors, width)
        n = rows.count()
        count = min(MAX_LISTS, lists or math.isqrt(n), max(n, 1))
        drawn = rows.orderBy(F.xxhash64(self.key, F.lit(SEED)), self.key).limit(SAMPLE)
        unit = drawn.mapInArrow(_units, "x array<double>").select(array_to_vector("x").alias("features"))
        centroids: list = []
        if count > 1:
            unit = unit.persist()
            fitted = KMeans(k=count, maxIter=8, seed=SEED, initMode="random").fit(unit)
            unit.unpersist()
            centroids = [c.tolist() for c in fitted.clusterCenters()]
        elif n:
            centroids = [[0.0] * width]
        schema = "list int, width int, x array<double>"
        found = [(i, width, c) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(found, schema).coalesce(1).write.mode("overwrite").parquet(self._at("centroids"))
        self._centroids = None
        return self.add(vectors, "first")

    def add(self, vectors: DataFrame, segment: str) -> VectorIndex:
        """Puts rows into the lists as ``segment``; an earlier segment of that name is replaced."""
        centroids = self.centroids()
        rows = self._usable(vectors, centroids.shape[1] if len(centroids) else 0)
        schema = t.StructType([*rows.schema.fields]).add("list", t.IntegerType()).add("angle", t.DoubleType())
        placed = rows.mapInArrow(_placed(centroids), schema)
        # In list order, so that a reader skips the row groups of other lists.
        placed.repartition("list").sortWithinPartitions("list").write.mode("overwrite").parquet(
            os.path.join(self._at("vectors"), f"segment={segment}")
        )
        return self

    def _usable(self, vectors: DataFrame, width: int) -> DataFrame:
        rows = vectors.select(F.col(self.key), F.col(self.vec).cast("array<double>").alias("_vec"))
        turned = F.exists("_vec", lambda x: x != 0)
        return rows.filter(usable(F.col("_vec"), width) & F.lit(width > 0)).filter(turned)

    # ------------------------------------------------------------------------------------------ reading

    def centroids(self) -> np.ndarray:
        if self._centroids is None:
            rows = self.spark.read.parquet(self._at("centroids")).orderBy("list").collect()
            x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, 0))
            self._centroids = _unit(x) if len(x) else x
        return self._centroids

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self._at("vectors")).drop("segment")

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and radius of every list, over all segments: two numbers per list."""
        count = len(self.centroids())
        sizes, radii = np.zeros(count, np.int64), np.zeros(count)
        for r in self.vectors().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
            sizes[r["list"]], radii[r["list"]] = r["n"], r["r"]
        return sizes, radii

    def search(
        self, queries: DataFrame, query_id: str, query_vec: str, k: int, probes: int | None = None,
        digits: int | None = None,
    ) -> DataFrame:
        """The ``k`` nearest indexed vectors of every query: ``query_id``, the key, ``score`` and ``rank``.

        Ties go to the smaller key. With ``probes`` only that many nearest lists are looked at. Without, the result is
        exact: after the nearest lists, all those are looked at whose bound is not below the k-th score found there.
        Queries without a usable vector have no rows. Scores are rounded to ``digits`` before they are ranked.
        """
        centroids = self.centroids()
        asked = queries.select(
            F.col(query_id).alias("_query"), F.col(query_vec).cast("array<double>").alias("_asked")
        )
        asked = asked.filter(usable(F.col("_asked"), centroids.shape[1])).filter(F.exists("_asked", lambda x: x != 0))
        sizes, radii = self.lists()
        first = probes if probes is not None else max(1, math.isqrt(len(centroids)))
        found = self._compared(_routed(asked, centroids, sizes, radii, first), query_id, k, digits, sizes)
        if probes is None:
            found = found.persist()
            best = Window.partitionBy(query_id).orderBy(F.desc("score"), self.key)
            kth = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k)
            kth = kth.select(F.col(query_id).alias("_query"), F.col("score").alias("_bound"))
            bounded = asked.join(kth, "_query", "left")
            rest = self._compared(_routed(bounded, centroids, sizes, radii, first, digits), query_id, k, digits, sizes)
            found = found.unionByName(rest)
        best = Window.partitionBy(query_id).orderBy(F.desc("score"), self.key)
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select(query_id, self.key, "score", "rank")

    def _compared(self, routed: DataFrame, query_id: str, k: int, digits: int | None, sizes: np.ndarray) -> DataFrame:
        """The best rows of each list that a query was sent to; long lists and many queries are cut into pieces."""
        rows = self.vectors().select(self.key, "_vec", "list")
        schema = t.StructType([
            t.StructField(query_id, routed.schema["_query"].dataType), rows.schema[self.key],
            t.StructField("score", t.DoubleType()),
        ])
        pieces = F.array(*[F.lit(int(max(1, -(-n // PIECE)))) for n in sizes]) if len(sizes) else F.array(F.lit(1))
        wanted = dict(routed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect())
        parts = F.array(*[F.lit(int(max(1, -(-wanted.get(i, 0) // PART)))) for i in range(max(1, len(sizes)))])
        left = routed.select("_query", "_asked", "list").withColumn(
            "_q", F.pmod(F.xxhash64("_query"), F.get(parts, "list")).cast("int")
        ).withColumn("_c", F.explode(F.sequence(F.lit(0), F.get(pieces, "list") - 1)))
        # Rows are dealt by key and value: copies of a key are no hot piece.
        right = rows.withColumn(
            "_c", F.pmod(F.xxhash64(self.key, "_vec"), F.get(pieces, "list")).cast("int")
        ).withColumn("_q", F.explode(F.sequence(F.lit(0), F.get(parts, "list") - 1)))
        score = _scorer(query_id, [self.key], "cosine", k, None, digits)
        return _meeting(left, right, ["list", "_q", "_c"], score, schema)

    def probes_for(self, recall: float, k: int, tried: int = TRIED) -> int:
        """The least number of lists with which ``tried`` indexed vectors, drawn by hash, find that share of their
        true ``k`` nearest others (they find themselves at once)."""
        drawn = self.vectors().orderBy(F.xxhash64(self.key, F.lit(SEED + 1)), self.key).limit(tried)
        asked = drawn.select(F.monotonically_increasing_id().alias("_q"), F.col("_vec").alias("_v"))
        rows = self.spark.createDataFrame(asked.collect(), "_q long, _v array<double>")
        true = self.search(rows, "_q", "_v", k + 1)
        own = self.vectors().select(self.key, "list").dropDuplicates([self.key])
        # For every true neighbour, how many lists are nearer to the query than its own.
        centroids = self.centroids()
        places = {r["_q"]: np.argsort(np.argsort(_angles(_unit(np.array([r["_v"]])), centroids)[0])) for r in rows.collect()}
        ranks = sorted(
            int(places[r["_q"]][r["list"]]) + 1 for r in true.filter("rank > 1").join(own, self.key).select("_q", "list").collect()
        )
        return ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))] if ranks else 1


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index("_vec")))
        yield pa.RecordBatch.from_arrays([pa.array(list(_unit(x)) if len(x) else [], pa.list_(pa.float64()))], ["x"])


def _placed(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_unit(_matrix(batch.column(batch.schema.get_field_index("_vec")))), centroids)
            place = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place.astype(np.int32)), pa.array(angles[np.arange(len(place)), place])],
                [*batch.schema.names, "list", "angle"],
            )

    return run


def _routed(
    asked: DataFrame, centroids: np.ndarray, sizes: np.ndarray, radii: np.ndarray, first: int, digits: int | None = None
) -> DataFrame:
    """Queries with the lists they are sent to: the ``first`` nearest; or, where ``_bound`` says what was found there,
    those of the others that may hold something as near (all others where it is null)."""
    full = sizes > 0
    bounded = "_bound" in asked.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centroids):
                continue
            angles = _angles(_unit(_matrix(batch.column(batch.schema.get_field_index("_asked")))), centroids)
            angles[:, ~full] = np.inf
            near = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable") < first
            if bounded:
                known = np.asarray(batch.column(batch.schema.get_field_index("_bound")).fill_null(-2.0))
                # A score is rounded up by half a unit at most.
                known = known - (0 if digits is None else 10.0**-digits)
                near = ~near & (np.cos(np.clip(angles - radii - SLACK, 0, math.pi)) >= known[:, None])
            rows, lists = np.nonzero(near & full)
            picked = batch.select(["_query", "_asked"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lists.astype(np.int32))], ["_query", "_asked", "list"])

    schema = t.StructType([asked.schema["_query"], asked.schema["_asked"], t.StructField("list", t.IntegerType())])
    return asked.mapInArrow(run, schema)
