"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees.

Every vector gets, for each of ``TREES`` trees, a string of ``BITS`` signs of random projections. A tree is the sorted
array of these strings, cut into blocks by their first bits. Vectors at an angle of t agree in one sign with
probability p = 1 - t / pi, so they share a prefix of d signs with probability p^d.

1. Descent: in a few trees a query looks at the entries whose strings share the longest prefixes with its own, which
   are those around its place in the sorted array. The (k+1)th best cosine among them bounds from above the angle at
   which the true neighbours lie.
2. Synchronous ascent: from the full strings the query goes up, one tree after the other to the same depth, then all
   one sign higher, until a vector at that angle meets it in some tree with probability ``TARGET``. Where it lies in
   dense data the bound is small and it stays at long prefixes; no count of candidates stops it early.
3. All vectors that share the prefix reached are compared with the query, in double precision, where the tree's block
   lies; a block gives up the best few of each query.

Equal vectors are one entry, however many rows have them. A block that holds too much is split into pieces, and its
queries into parts, so that no task holds more than a bounded number of either; a query meets every piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.bounded import broadcast_if_small
from lectern.llm.common import written

K = 5
EVERY = 50
TREES = 32
BITS = 48
TARGET = 0.95
#: Trees of the descent, and the entries around its place that a query looks at in each.
FIRST_TREES = 8
AROUND = 1024
#: Bytes of vectors in one piece of a block, and queries compared with it in one task.
PIECE_BYTES = 4 << 20
PART = 2048
#: Products in one matrix.
CELLS = 1 << 22
SEED = 11
CLOSE = 1e-9


def _vectors(kind: type) -> Callable:
    """Rows whose vector has a direction: its bytes, the class of equal vectors and the sign strings."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            ids, asked = (batch.column(batch.schema.get_field_index(n)) for n in ("id", "asked"))
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            flat = lists.flatten()
            holes = np.asarray(flat.is_null())
            values = np.asarray(flat.fill_null(math.nan), kind) + kind(0)  # -0.0 becomes 0.0
            ends = np.cumsum(lengths)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values) | holes)))
            full = np.concatenate(([0], np.cumsum(values != 0)))
            usable = (lengths > 0) & (bad[ends] == bad[ends - lengths]) & (full[ends] > full[ends - lengths])
            out: list[list] = [[], [], []]
            order: list[np.ndarray] = []
            for dim in np.unique(lengths[usable]):
                rows = np.flatnonzero(usable & (lengths == dim))
                x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                if dim not in planes:
                    rng = np.random.default_rng([SEED, int(dim)])
                    planes[dim] = rng.standard_normal((int(dim), TREES * BITS), np.float32)
                for part in np.array_split(np.arange(len(rows)), max(1, len(rows) // 512)):
                    y = x[part].astype(np.float64)
                    y /= np.abs(y).max(axis=1, keepdims=True)
                    out[2] += list(_strings((y.astype(np.float32) @ planes[dim]) >= 0))
                body = np.ascontiguousarray(x).view(np.uint8).reshape(len(rows), int(dim) * size)
                out[0] += (vectors := [r.tobytes() for r in body])
                out[1] += [xxhash.xxh3_128_digest(v) for v in vectors]
                order.append(rows)
            at = pa.array(np.concatenate(order) if order else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at), asked.take(at), pa.array(out[1], pa.binary()), pa.array(out[0], pa.binary()),
                    pa.array(out[2], pa.list_(pa.int64())),
                ],
                ["id", "asked", "class", "vector", "codes"],
            )

    return run


def _strings(signs: np.ndarray) -> np.ndarray:
    """Sign strings as numbers, the first sign highest: (rows, TREES)."""
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return signs.reshape(len(signs), TREES, BITS) @ weights


def _matrix(column_: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Vectors of one length, as they are stored."""
    joined = b"".join(column_.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column_), -1)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles, each row divided by a power of two so that squares neither overflow nor vanish, and their lengths.

    Sums run over the components in order, so a score is the same wherever it is computed.
    """
    y = x.astype(np.float64)
    _, exponent = np.frexp(np.abs(y).max(axis=1)) if len(y) else (None, np.zeros(0, np.int32))
    y = np.ldexp(y, -exponent[:, None])
    total = np.zeros(len(y))
    for j in range(y.shape[1] if len(y) else 0):
        total += y[:, j] * y[:, j]
    return y, np.sqrt(total)


def _cosines(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total / (nx * ny)


class _Entries:
    """One piece of a block of one tree, in the order of the strings."""

    def __init__(self, table: pa.Table, kind: type):
        codes = np.asarray(table["code"])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.rows, self.norms = _scaled(_matrix(table["vector"], kind)[order])
        self.unit = self.rows / self.norms[:, None]
        self.order = order

    def best(self, queries: np.ndarray, norms: np.ndarray, low: int, high: int, most: int):
        """(query, entry, cosine) of the best ``most`` entries in a range, and of those that tie with the last."""
        width = high - low
        for start in range(0, len(queries), max(1, CELLS // max(width, 1))):
            part = slice(start, start + max(1, CELLS // max(width, 1)))
            near = (queries[part] / norms[part, None]) @ self.unit[low:high].T
            if width > most:
                last = np.partition(near, width - most, axis=1)[:, width - most]
                q, e = np.nonzero(near >= last[:, None] - CLOSE)
            else:
                q, e = (x.ravel() for x in np.indices(near.shape))
            q, e = q + start, e + low
            for at in np.array_split(np.arange(len(q)), max(1, len(q) * queries.shape[1] // CELLS)):
                yield q[at], e[at], _cosines(queries[q[at]], norms[q[at]], self.rows[e[at]], self.norms[e[at]])


HIT = pa.schema([("asker", pa.binary()), ("class", pa.binary()), ("least", pa.int64()), ("score", pa.float64())])
HITS = "asker binary, class binary, least long, score double"


def _few(asker, entry, score, entries: _Entries, table: pa.Table, asked: pa.Table, most: int) -> pa.Table:
    """The best of each query as a table: highest score, then least id, null last."""
    least = np.asarray(pc.fill_null(table["least"], np.iinfo(np.int64).max), np.int64)[entries.order[entry]]
    order = np.lexsort((least, -score, asker))
    asker, entry, score = asker[order], entry[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], asker[1:] != asker[:-1]))) if len(asker) else np.zeros(0, np.int64)
    place = np.arange(len(asker)) - np.repeat(first, np.diff(np.append(first, len(asker))))
    keep = place < most
    at = pa.array(entries.order[entry[keep]])
    return pa.Table.from_arrays(
        [
            asked["class"].take(pa.array(asker[keep])).combine_chunks(), table["class"].take(at).combine_chunks(),
            table["least"].take(at).combine_chunks(), pa.array(score[keep], pa.float64()),
        ],
        schema=HIT,
    )


def _joined(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _descended(kind: type, most: int):
    """Entries around each query's place in a sorted array: those with the longest common prefixes."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return HIT.empty_table()
        entries = _Entries(table, kind)
        queries, norms = _scaled(_matrix(asked["vector"], kind))
        place = np.searchsorted(entries.codes, np.asarray(asked["code"]))
        found = []
        for q, at in enumerate(place):
            low = max(0, min(at - AROUND // 2, len(entries.codes) - AROUND))
            high = min(len(entries.codes), low + AROUND)
            for _, e, s in entries.best(queries[q : q + 1], norms[q : q + 1], low, high, most):
                found.append((np.full(len(e), q), e, s))
        return _few(*_joined(found), entries, table, asked, most)

    return run


def _ascended(kind: type, most: int):
    """All entries that share with a query the prefix it has gone up to."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return HIT.empty_table()
        entries = _Entries(table, kind)
        queries, norms = _scaled(_matrix(asked["vector"], kind))
        rest = BITS - np.asarray(asked["depth"], np.int64)
        low = (np.asarray(asked["code"], np.int64) >> rest) << rest
        start = np.searchsorted(entries.codes, low)
        stop = np.searchsorted(entries.codes, low + (np.int64(1) << rest))
        found, order = [], np.lexsort((stop, start))
        cuts = np.flatnonzero((np.diff(start[order]) != 0) | (np.diff(stop[order]) != 0)) + 1
        for same in np.split(order, cuts):
            a, b = int(start[same[0]]), int(stop[same[0]])
            if a < b:
                for q, e, s in entries.best(queries[same], norms[same], a, b, most):
                    found.append((same[q], e, s))
        return _few(*_joined(found), entries, table, asked, most)

    return run


def _met(entries: DataFrame, queries: DataFrame, rows: int, compare: Callable) -> DataFrame:
    """Queries and entries of the same block, in pieces of about ``rows`` entries and parts of ``PART`` queries."""
    keys = ["dim", "tree", "block"]
    held = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))
    meet = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"))
    full = held.join(meet, keys).select(
        *keys, F.ceil(F.col("entries") / rows).cast("int").alias("pieces"),
        F.ceil(F.col("queries") / PART).cast("int").alias("parts"),
    )
    full = broadcast_if_small(full.filter("pieces > 1 OR parts > 1"))

    def spread(df: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        known = df.join(full, keys, "left")
        known = known.withColumn(own, F.pmod(F.xxhash64("class", F.lit(1)), F.coalesce(count, F.lit(1))).cast("int"))
        every = F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)
        return known.withColumn(other, F.explode(every)).drop("pieces", "parts")

    left = spread(entries, "piece", "pieces", "part", "parts")
    right = spread(queries, "part", "parts", "piece", "pieces")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table
    by = [*keys, "piece", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, HITS)


def depth_for(score: Column) -> tuple[Column, Column]:
    """How far a query goes up that looks for vectors of this cosine: a depth, and the number of trees that reach it.

    The other trees stay one sign lower. Without a score it goes up to the root.
    """
    agree = 1 - F.acos(F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))) / math.pi
    agree = F.greatest(agree, F.lit(1e-6))
    needed = math.log(1 - (1 - TARGET) ** (1 / TREES))
    depth = F.when(agree >= 1, BITS).otherwise(F.least(F.floor(F.lit(needed) / F.log(agree)), F.lit(BITS)))
    depth = F.when(score.isNull(), 0).otherwise(depth).cast("int")
    here, lower = (F.log1p(-F.pow(agree, depth + i)) for i in (0, 1))
    trees = F.ceil((math.log(1 - TARGET) - TREES * lower) / (here - lower))
    trees = F.when((depth == 0) | (depth == BITS), TREES).otherwise(F.greatest(F.least(trees, F.lit(TREES)), F.lit(0)))
    return depth, F.coalesce(trees, F.lit(TREES)).cast("int")


def _classes(vectors: DataFrame, asks: Column, key: str, vector: str) -> tuple[DataFrame, type]:
    """(id, asked, class, vector, codes) of the rows that take part."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asked"),
        F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"),
    )
    kind = np.float32 if single else np.float64
    found = rows.mapInArrow(
        _vectors(kind), "id long, asked boolean, class binary, vector binary, codes array<long>"
    )
    return written(found, "neighbours-vectors"), kind


def search(
    vectors: DataFrame, asks: Column, k: int = K, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of every row for which ``asks`` holds: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Nearest is the largest cosine, ties go to the smaller id (null last); the row itself is no neighbour of its own.
    Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different
    lengths are no neighbours. Repeated rows are rows of their own: each copy of a query has an answer, and copies are
    neighbours. A null id can't ask. Other columns are not read. With fewer than k + 1 different vectors around it a
    query goes up to the root and so gets all there are.
    """
    most = k + 1
    rows, kind = _classes(vectors, asks, key, vector)
    classes = rows.groupBy("class").agg(
        F.first("vector").alias("vector"), F.first("codes").alias("codes"), F.min("id").alias("least"),
        F.max("asked").alias("asked"),
    )
    classes = classes.withColumn("dim", F.octet_length("vector"))
    classes = written(classes, "neighbours-classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("bytes")).first()
    piece = max(64, PIECE_BYTES // (size["bytes"] or 1))
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, size["n"] / piece)))))
    block = F.shiftrightunsigned("code", BITS - bits)
    tree_of = F.posexplode("codes").alias("tree", "code")
    entries = classes.select("class", "vector", "least", "dim", tree_of).withColumn("block", block)
    asked = classes.filter("asked").select("class", "vector", "dim", "codes")
    # Descent.
    queries = asked.select("class", "vector", "dim", tree_of).withColumn("block", block)
    near = F.col("tree") < FIRST_TREES
    first = _met(entries.filter(near), queries.filter(near), piece, _descended(kind, most))
    first = first.groupBy("asker", "class").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("asker").orderBy(F.desc("score"), "class")
    first = first.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= most)
    bound = first.groupBy(F.col("asker").alias("class")).agg(
        F.when(F.count(F.lit(1)) == most, F.min("score") - CLOSE).alias("score")
    )
    depth, trees = depth_for(F.col("score"))
    asked = asked.join(bound, "class", "left").withColumn("depth", depth).withColumn("up", trees).drop("score")
    asked = written(asked, "neighbours-queries")
    # Ascent: at the root every tree holds everything, so one is enough.
    queries = asked.select("class", "vector", "dim", "depth", "up", tree_of).filter("depth > 0 OR tree = 0")
    queries = queries.withColumn("depth", F.col("depth") + F.when(F.col("tree") >= F.col("up"), 1).otherwise(0))
    above = F.greatest(F.lit(bits) - F.col("depth"), F.lit(0))
    lowest = F.expr(f"shiftleft(shiftrightunsigned(code, {BITS - bits} + above), above)")
    queries = queries.withColumn("above", above).withColumn("low", lowest)
    queries = queries.withColumn(
        "block", F.explode(F.sequence("low", F.expr("low + shiftleft(bigint(1), above) - 1")))
    ).drop("above", "low", "up")
    hits = _met(entries, queries, piece, _ascended(kind, most))
    hits = hits.groupBy("asker", "class").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("least"), "class")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    hits = written(hits.select("asker", "class", "score"), "neighbours-hits")
    return _answers(rows, hits, k)


def _answers(rows: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Classes back to rows: the k nearest ids of every row that asks, without that row itself."""
    least = Window.partitionBy("class").orderBy(F.asc_nulls_last("id"))
    members = rows.select("id", "class").join(hits.select("class").distinct().hint("merge"), "class", "left_semi")
    members = members.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1)
    near = hits.join(members.select("class", "id").hint("merge"), "class")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    item = F.struct("place", "score", "id", (F.col("asker") == F.col("class")).alias("own"))
    lists = near.groupBy(F.col("asker").alias("class")).agg(F.sort_array(F.collect_list(item)).alias("near"))
    asked = rows.filter("asked").groupBy("class", F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("times"))
    met = asked.join(lists.hint("merge"), "class")
    self = F.array_position(F.transform("near", lambda x: x["own"] & x["id"].eqNullSafe(F.col("query_id"))), True)
    others = F.filter("near", lambda x, i: i + 1 != F.col("self"))
    found = met.withColumn("self", self).select(
        "query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"), "times"
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return found.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
        F.col("x.score").alias("score"), copies.alias("copy"),
    ).drop("copy")


def op11(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % EVERY == 0)
