"""Best-scoring vectors by cosine or Euclidean distance, exact, without shuffling the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_type

from lectern.session import cut

# Bytes of query vectors a task may hold, and the tile scored at once inside it.
MAX_BLOCK_BYTES = 32 << 20
TILE_ROWS = 2048
TILE_QUERIES = 1024
MAX_PIVOTS = 256
# Pairs up to which every row meets every query by distance; queries and rows that meet in one task beyond that.
MAX_SCAN_PAIRS = 50_000_000
SHARE_ROWS = 16_384
CELL_ROWS = 65_536
# Vectors up to this length are compared leaf by leaf, and rows of such a leaf.
BOXED = 16
LEAF_ROWS = 256
MAX_MEETINGS = 4096


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usual_size(df: DataFrame, vec: str) -> int:
    """The commonest length of the vectors, the longer of equals; 0 when there are none."""
    sizes = df.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def usable(vec: Column, size: int) -> Column:
    """Whether a vector has the length and nothing but finite numbers."""
    def finite(x):
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    return F.coalesce((F.size(vec) == size) & F.forall(vec, finite), F.lit(False))


def best_rows(score: np.ndarray, k: int | None, threshold: float | None) -> np.ndarray:
    """Mask of rows (axis 0, in tie order) above the threshold and among the best k per column."""
    keep = np.ones(score.shape, dtype=bool) if threshold is None else score > threshold
    if k is not None and score.shape[0] > k:
        edge = np.partition(score, -k, axis=0)[-k]
        above, equal = score > edge, score == edge
        room = k - above.sum(axis=0)
        keep &= above | (equal & (equal.cumsum(axis=0) <= room))
    return keep


def nearest(
    corpus: DataFrame,
    vec: str,
    queries: DataFrame,
    query_id: str,
    query_vec: str,
    keep: list[str],
    metric: str = "cosine",
    k: int | None = None,
    threshold: float | None = None,
    digits: int | None = None,
    others: bool = False,
) -> DataFrame:
    """(query, row, score) for the best rows of every corpus block; the caller ranks them per query.

    ``keep[0]`` identifies a corpus row and breaks ties. Cosine is 0 when a norm is 0; for Euclidean the score
    is the negative distance. Query vectors proven to fit ``MAX_BLOCK_BYTES`` are broadcast and the corpus is
    scored where it is read. More of them meet the corpus block by block in a shuffle; for the k nearest by distance, if
    the pairs are many, only in those cells around pivots that can hold one of them. Either way a block gives
    up at most ``k`` rows per query, copies included; without ``k`` every pair above the threshold is written. With
    ``others`` a row whose key is the query's, or null, is no answer.
    Vectors that are null, hold a null or NaN, or differ from the usual length of the queries score nothing.
    """
    id_type = queries.schema[query_id].dataType
    schema = t.StructType(
        [t.StructField(query_id, id_type)]
        + [corpus.schema[c] for c in keep]
        + [t.StructField("score", t.DoubleType())]
    )
    width = usual_size(queries, query_vec)
    asked = queries.select(
        F.col(query_id).alias("_query"), F.col(query_vec).cast("array<double>").alias("_asked")
    ).filter(usable(F.col("_asked"), width))
    slim = corpus.select(*keep, F.col(vec).cast("array<double>").alias("_vec")).filter(usable(F.col("_vec"), width))
    if others:
        slim, asked = slim.filter(F.col(keep[0]).isNotNull()), asked.filter(F.col("_query").isNotNull())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_asked")).alias("d")).first()
    if not size["n"]:
        return corpus.sparkSession.createDataFrame([], schema)
    per_block = max(1, MAX_BLOCK_BYTES // (8 * max(1, size["d"])))
    score = _scorer(query_id, keep, metric, k, threshold, digits, others)
    if metric == "euclidean" and k is not None and threshold is None:
        n_corpus = slim.count()
        if size["n"] > per_block or size["n"] * n_corpus > MAX_SCAN_PAIRS:
            slim = _few_copies(slim, keep[0], k, others)
            return _by_cells(slim, asked, keep[0], n_corpus, k, per_block, score, schema, digits)
    if size["n"] > per_block:
        return _by_blocks(slim, asked, keep[0], size["n"], per_block, score, schema)
    shared = corpus.sparkSession.sparkContext.broadcast(asked.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from score(batch, shared.value)

    return slim.mapInArrow(scan, schema)


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(vectors - p, axis=1) for p in pivots], axis=1)


def _few_copies(slim: DataFrame, key: str, k: int, others: bool) -> DataFrame:
    """At most the copies of a vector that can be among a query's k nearest: those with the smallest keys.

    Where a query's own key is no answer, k rows of other keys must be left.
    """
    if others:
        same = Window.partitionBy("_vec", key).orderBy(key)
        slim = slim.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k)
    copies = Window.partitionBy("_vec").orderBy(key)
    return slim.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= (2 * k if others else k)).drop("_n")


def reachable_cells(distances: np.ndarray, radii: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which cells can hold one of the k nearest rows, for queries with these distances to the pivots.

    The cells that are surely reached within some distance hold k rows, so the k-th neighbour is no farther; by the
    triangle inequality a cell whose pivot is farther than that plus its radius holds none of them.
    """
    reach = distances + radii
    order = np.argsort(reach, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), counts.size - 1)
    bound = np.take_along_axis(reach, order, axis=1)[np.arange(len(reach)), at]
    slack = 1e-6 * (1.0 + bound)  # rounding of distances must not lose a neighbour
    return (distances - radii <= (bound + slack)[:, None]) & (counts > 0)


def _by_cells(slim, asked, key, n_corpus, k, per_block, score, schema, digits, most: int = MAX_PIVOTS) -> DataFrame:
    """Corpus rows in cells around pivots; a query meets its own cell, then those that can hold something as near.

    The distance of the k-th row found in a query's own cell bounds it: by the triangle inequality a cell whose pivot is
    farther than that plus its radius holds none nearer. The pivots are rows drawn by hash, one per cell of rows. The
    driver holds the pivots and one radius and count per cell: at most ``most`` rows. Cells and their queries are cut
    into blocks by hash, so a cell of copies spreads out.
    """
    cell_rows, share_rows = min(4 * per_block, CELL_ROWS), min(per_block, SHARE_ROWS)
    drawn = slim.orderBy(F.xxhash64(key, F.lit(3)), key).select("_vec").limit(min(most, -(-n_corpus // cell_rows))).collect()
    if not drawn:
        return slim.sparkSession.createDataFrame([], schema)
    pivots = np.array([r["_vec"] for r in drawn])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                d = _pivot_distances(_matrix(batch.column(batch.schema.get_field_index("_vec"))), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                    [*batch.schema.names, "_cell", "_far"],
                )

    placed_schema = t.StructType([*slim.schema.fields]).add("_cell", t.IntegerType()).add("_far", t.DoubleType())
    placed = cut(slim.mapInArrow(place, placed_schema))
    stats = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("r")).collect()
    counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in stats:
        counts[row["_cell"]], radii[row["_cell"]] = row["n"], row["r"]
    step = 0.0 if digits is None else 10.0**-digits

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _pivot_distances(_matrix(batch.column(batch.schema.get_field_index("_asked"))), pivots)
            own = np.where(counts > 0, d, np.inf).argmin(axis=1)
            reach = np.zeros(d.shape, dtype=bool)
            reach[np.arange(len(d)), own] = True
            if "_bound" in batch.schema.names:
                found = -np.asarray(batch.column(batch.schema.get_field_index("_bound")).fill_null(-np.inf))
                slack = np.where(np.isfinite(found), 1e-6 * (1.0 + found) + step, 0.0)
                reach = ~reach & (d - radii <= (found + slack)[:, None]) & (counts > 0)
            rows, cells = np.nonzero(reach)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "_cell"])

    def met(queries: DataFrame) -> DataFrame:
        routed = queries.mapInArrow(route, t.StructType([*queries.schema.fields]).add("_cell", t.IntegerType()))
        wanted = dict(routed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect())
        n_blocks = [int(max(1, -(-int(n) // cell_rows))) for n in counts]
        n_shares = [int(max(1, -(-wanted.get(c, 0) // share_rows))) for c in range(len(counts))]
        blocks, shares = (F.array(*[F.lit(n) for n in sizes]) for sizes in (n_blocks, n_shares))
        left = routed.withColumn("_q", F.pmod(F.xxhash64("_query", "_asked"), F.get(shares, "_cell")).cast("int")).withColumn(
            "_c", F.explode(F.sequence(F.lit(0), F.get(blocks, "_cell") - 1))
        )
        right = placed.drop("_far").withColumn("_c", F.pmod(F.xxhash64(key, "_vec"), F.get(blocks, "_cell")).cast("int")).withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.get(shares, "_cell") - 1))
        )
        # A given number of tasks: small vectors make much work in few bytes, by which tasks would be put together.
        keys, tasks = ["_cell", "_q", "_c"], min(MAX_MEETINGS, sum(b * s for b, s in zip(n_blocks, n_shares)))
        return _meeting(left.repartition(tasks, *keys), right.repartition(tasks, *keys), keys, score, schema)

    query_id = schema.fields[0].name
    first = cut(met(asked))
    if len(pivots) == 1:
        return first
    best = Window.partitionBy(query_id).orderBy(F.desc("score"))
    bounds = (
        first.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k)
        .select(F.col(query_id).alias("_query"), F.col("score").alias("_bound"))
    )
    return first.unionByName(met(cut(asked.join(bounds, "_query", "left").select("_query", "_asked", "_bound"))))


def _meeting(left, right, keys, score, schema) -> DataFrame:
    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        if not queries.num_rows or not rows.num_rows:
            return target.empty_table()
        found = list(score(rows.combine_chunks().to_batches()[0], queries))
        return pa.Table.from_batches(found).cast(target)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _by_blocks(slim, asked, key, n_asked, per_block, score, schema) -> DataFrame:
    """Both sides hashed into blocks of bounded size; every pair of blocks meets in one task.

    Blocks are formed by a hash of the row keys, so copies of a vector spread out like any other rows.
    """
    n_corpus = slim.count()
    q_blocks = -(-n_asked // per_block)
    c_blocks = max(1, -(-n_corpus // (4 * per_block)))
    left = asked.withColumn("_q", F.pmod(F.xxhash64("_query"), F.lit(q_blocks)).cast("int")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )
    right = slim.withColumn("_c", F.pmod(F.xxhash64(key), F.lit(c_blocks)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )

    return _meeting(left, right, ["_q", "_c"], score, schema)


def leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows cut at the median of their widest side until at most ``size`` are together."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(np.sort(rows))
            continue
        part = x[rows]
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class _Best:
    """The best k rows of every query of a tile while the rows go by: ties go to the row that comes first."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.edge, self.n = k, least, n
        self.cols, self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, tile: np.ndarray, at: np.ndarray, own: np.ndarray, threshold: float | None) -> None:
        """Scores of the rows ``at`` for the queries ``own``."""
        hit = tile >= self.edge[own]
        if threshold is not None:
            hit &= tile > threshold
        if hit.sum() > 4 * self.k * len(own):
            hit &= best_rows(tile, self.k, None)
        rows, cols = np.nonzero(hit)
        if not len(rows):
            return
        cols, scores = np.concatenate([self.cols, own[cols]]), np.concatenate([self.scores, tile[rows, cols]])
        rows = np.concatenate([self.rows, at[rows]])
        order = np.lexsort((rows, -scores, cols))
        cols = cols[order]
        place = np.arange(len(cols)) - np.searchsorted(cols, np.arange(self.n))[cols]
        kept = order[place < self.k]
        full = place == self.k - 1
        self.edge[cols[full]] = scores[order][full]
        self.cols, self.rows, self.scores = cols[place < self.k], rows[kept], scores[kept]


def _scorer(query_id, keep, metric, k, threshold, digits, others=False):
    def score_tile(d: np.ndarray, q: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            scale = np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
            out = np.divide(d @ q.T, scale, out=np.zeros_like(scale), where=scale > 0)
        elif d.shape[1] <= BOXED:
            out = -np.sqrt(sum((d[:, i, None] - q[None, :, i]) ** 2 for i in range(d.shape[1])))
        else:
            squared = (d * d).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2.0 * (d @ q.T)
            out = -np.sqrt(np.maximum(squared, 0.0))
        return out if digits is None else np.round(out, digits)

    def reachable(gap):
        """The best score that a distance of at least ``gap`` can have after rounding."""
        return -gap + 1e-9 * (1.0 + gap) + (0.0 if digits is None else 10.0**-digits)

    def taken(batch, ids, rows, cols, scores) -> pa.RecordBatch:
        picked = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(cols)), *[picked.column(c) for c in keep], pa.array(scores)], names=[query_id, *keep, "score"]
        )

    def every(batch, d, ids, q) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(d), TILE_ROWS):
            for first in range(0, len(q), TILE_QUERIES):
                tile = score_tile(d[start : start + TILE_ROWS], q[first : first + TILE_QUERIES])
                rows, cols = np.nonzero(best_rows(tile, None, threshold))
                yield taken(batch, ids, rows + start, cols + first, tile[rows, cols])

    def best(batch, d, ids, q, bound) -> Iterator[pa.RecordBatch]:
        boxed = metric == "euclidean" and d.shape[1] <= BOXED
        if boxed:
            parts, asked = leaves(d, LEAF_ROWS), leaves(q, LEAF_ROWS)
            low, high = (np.array([f(d[p], axis=0) for p in parts]) for f in (np.min, np.max))
        else:
            parts = np.split(np.arange(len(d)), range(TILE_ROWS, len(d), TILE_ROWS))
            asked = np.split(np.arange(len(q)), range(TILE_QUERIES, len(q), TILE_QUERIES))
        if others:
            keys = batch.column(keep[0])
            known = pc.unique(keys)
            row_key, own_key = (np.asarray(pc.index_in(c, known).fill_null(-1)) for c in (keys, ids))
        for at in asked:
            found = _Best(len(at), k, bound[at].copy())
            order, gap = np.arange(len(parts)), np.zeros(len(parts))
            if boxed:
                # No row of a leaf is nearer to a query of the tile than their boxes are.
                apart = np.maximum(0.0, np.maximum(low - q[at].max(axis=0), q[at].min(axis=0) - high))
                gap = np.sqrt((apart**2).sum(axis=1))
                order = np.argsort(gap, kind="stable")
            own = np.arange(len(at))
            for i in order:
                if boxed:
                    if reachable(gap[i]) < found.edge.min():
                        break
                    apart = np.maximum(0.0, np.maximum(low[i] - q[at], q[at] - high[i]))
                    own = np.flatnonzero(reachable(np.sqrt((apart**2).sum(axis=1))) >= found.edge)
                    if not len(own):
                        continue
                tile = score_tile(d[parts[i]], q[at[own]])
                if others:
                    tile[row_key[parts[i]][:, None] == own_key[at[own]][None, :]] = -np.inf
                found.add(tile, parts[i], own, threshold)
            yield taken(batch, ids, found.rows, at[found.cols], found.scores)

    def score(whole: pa.RecordBatch, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        if not whole.num_rows or not queries.num_rows:
            return
        ids, q = queries.column("_query").combine_chunks(), _matrix(queries.column("_asked"))
        batch = whole.take(pc.sort_indices(whole, sort_keys=[(keep[0], "ascending")], null_placement="at_start"))
        d = _matrix(batch.column("_vec"))
        if k is None:
            yield from every(batch, d, ids, q)
            return
        least = np.full(len(q), -np.finfo(float).max)
        if "_bound" in queries.column_names:
            bound = np.asarray(queries.column("_bound").combine_chunks().fill_null(-np.finfo(float).max))
            least = bound - (1e-9 * np.abs(bound) + 1e-9 if digits is None else 0.0)
        yield from best(batch, d, ids, q, least)

    return score
