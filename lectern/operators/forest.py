"""The library's regression forest for many rows: the same trees, grown from histograms of weighted rows (ML-13).

The library visits every row, tree and level. Here a task turns a block of rows into one weighted row per combination of
bins and tree, and grows the trees' histograms from these; where no two rows share their bins, a block keeps one
combination per row and the result is the same. Split points, draws of features, gains, leaves and pruning are the
library's; its Poisson weights come from one generator per partition and are drawn here by hashing a written row number
(to 16 bits, at most eight times a row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import run_dir

# Rows that a task weighs together, codes up to which combinations are found by counting, and the most a code may reach.
BLOCK_ROWS = 1 << 20
COUNTED_CODES = 1 << 22
MAX_CODES = 1 << 62
MAX_FEATURES = 64
# Distinct codes whose sums a task holds at once, and rows whose weights it holds.
PIECE_CODES = 1 << 14
CHUNK_ROWS = 1 << 13
# Partial sums that one group adds up.
FANIN = 64
# Rows from which split points are taken, as many as the library takes.
SPLIT_ROWS = 10_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


# ------------------------------------------------------------------------------------- draws


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_edges() -> list[int]:
    """The numbers of 16 bits from which on a Poisson number of mean one is at least 1, 2, 3, …"""
    chance, total, edges = np.exp(-1.0), 0.0, []
    for k in range(1, 20):
        total += chance
        chance /= k
        edges.append(int(round(total * (1 << 16))))
    return [e for e in edges if e < 1 << 16]


_EDGES = _poisson_edges()


def weights(ids: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Tree × row: the times that each row is drawn, from the row's number alone."""
    with np.errstate(over="ignore"):
        start = _mixed(ids.astype(np.uint64) * _GOLDEN + np.uint64(seed & _MASK))
        steps = np.arange(1, -(-trees // 4) + 1, dtype=np.uint64) * _GOLDEN
        bits = _mixed(start[None, :] + steps[:, None]).view(np.uint16)
    times = np.zeros(bits.shape, dtype=np.uint8)
    for edge in _EDGES:
        times += bits >= edge
    return times.reshape(len(steps), -1, 4).transpose(0, 2, 1).reshape(4 * len(steps), -1)[:trees].astype(np.float64)


class _JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        word = self.state >> 16
        return word - (1 << 32) if word >> 31 else word

    def next_long(self) -> int:
        return ((self._next() << 32) + self._next()) & _MASK


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words, as in Scala's library."""
    def rotl(x: int, n: int) -> int:
        return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF

    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = rotl(h ^ (rotl(k, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def _drawn_features(features: int, count: int, seed: int) -> list[int]:
    """The features a node may split on: the library's reservoir over its shifted-xor generator."""
    data = seed.to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    state = (_murmur(data, low) << 32) | low

    def bits(n: int) -> int:
        nonlocal state
        state ^= (state << 21) & _MASK
        state ^= state >> 35
        state ^= (state << 4) & _MASK
        return state & ((1 << n) - 1)

    kept = list(range(count))
    for i in range(count, features):
        at = int(((bits(26) << 27) + bits(27)) * 2.0**-53 * (i + 1))
        if at < count:
            kept[at] = i
    return kept


def _map_order(keys: list[int]) -> list[int]:
    """Order in which Scala's hash map yields whole numbers: by five bits of the hash at a time, entries before nodes."""
    def spread(k: int) -> int:
        h = (k + ~(k << 9)) & 0xFFFFFFFF
        h ^= h >> 14
        h = (h + (h << 4)) & 0xFFFFFFFF
        return h ^ (h >> 10)

    def walk(found: list[int], shift: int) -> list[int]:
        slots: dict[int, list[int]] = {}
        for k in found:
            slots.setdefault((spread(k) >> shift) & 31, []).append(k)
        alone = [v[0] for _, v in sorted(slots.items()) if len(v) == 1]
        return alone + [k for _, v in sorted(slots.items()) if len(v) > 1 for k in walk(v, shift + 5)]

    return list(keys) if len(keys) <= 4 else walk(keys, 0)


# ------------------------------------------------------------------------------------- splits


def split_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of one feature: all middles between its values, or those that part the rows most evenly."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= bins - 1:
        return middles
    stride = len(values) / bins
    out, target, seen = [], stride, int(counts[0])
    for i in range(1, len(distinct)):
        before, seen = seen, seen + int(counts[i])
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _variance(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def best_splits(sums: np.ndarray, subsets: np.ndarray, n_splits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node the place in its subset, the bin and the gain of its best split, the first of equals; else gain -1.

    ``sums`` is node × place × bin × (rows, labels, squares).
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None]
    right = total - left
    n = total[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _variance(*np.moveaxis(total, -1, 0)) - sum(
            side[..., 0] / n * _variance(*np.moveaxis(side, -1, 0)) for side in (left, right)
        )
    bin_no = np.arange(gain.shape[2])[None, None, :]
    fits = (left[..., 0] >= 1) & (right[..., 0] >= 1) & (bin_no < n_splits[subsets][:, :, None]) & (gain >= 0)
    flat = np.where(fits, gain, -1.0).reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(sums)), at]


# --------------------------------------------------------------------------------- histograms


def _combined(codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the place of each row's code among them."""
    if reach > COUNTED_CODES:
        return np.unique(codes, return_inverse=True)
    present = np.flatnonzero(np.bincount(codes, minlength=reach))
    place = np.zeros(reach, dtype=np.int64)
    place[present] = np.arange(len(present))
    return present, place[codes]


def _weighed(
    ids: np.ndarray, codes: np.ndarray, y: np.ndarray, reach: int, trees: int, seed: int, drawn: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct codes, some at a time, and their sums (rows, labels, squares) × tree × code over a block's rows."""
    present, place = _combined(codes, reach)
    # Rows of one code stand together, so a chunk's sums are sums of runs.
    order = np.argsort(place, kind="stable")
    ids, y, place = ids[order], y[order], place[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    for first in range(0, len(present), PIECE_CODES):
        last = min(first + PIECE_CODES, len(present))
        sums = np.zeros((3, trees, last - first))
        begin, end = starts[first], starts[last] if last < len(starts) else len(place)
        for a in range(begin, end, CHUNK_ROWS):
            b = min(a + CHUNK_ROWS, end)
            runs = slice(place[a] - first, place[b - 1] - first + 1)
            at = np.maximum(starts[place[a]:place[b - 1] + 1] - a, 0)
            w = weights(ids[a:b], trees, seed) if drawn else np.ones((trees, b - a))
            for k in range(3):
                sums[k, :, runs] += np.add.reduceat(w, at, axis=1)
                if k < 2:
                    w *= y[a:b]
        yield present[first:last], sums


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _added(table: pa.Table) -> pa.Table:
    """One row of sums for a group of them, added in the order of their parts."""
    ordered = table.sort_by("part")
    total = None
    for x in ordered["sums"]:
        one = np.frombuffer(x.as_py(), dtype=np.float64)
        total = one.copy() if total is None else total + one
    first = {"tree": [ordered["tree"][0].as_py()], "part": [ordered["part"][0].as_py() // FANIN]}
    return pa.table({**first, "sums": [total.tobytes()]}, schema=_SUMS)


_SUMS = pa.schema([("tree", pa.int32()), ("part", pa.int64()), ("sums", pa.binary())])
_SUMS_SQL = "tree int, part long, sums binary"


def _level(
    rows: DataFrame, parts: int, sizes: list[int], level: int, split_on: np.ndarray, split_at: np.ndarray,
    slots: np.ndarray, subsets: list[np.ndarray], bins: int, seed: int, drawn: bool,
) -> dict[int, np.ndarray]:
    """Per tree the sums of its open nodes. Nodes are numbered as in a heap; ``slots`` gives an open node's place."""
    reach = int(np.prod(sizes, dtype=object))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = len(subsets)
        totals = [np.zeros((3, s.size * bins)) for s in subsets]
        any_rows = False
        for block in _blocks(batches):
            any_rows = True
            for present, sums in _weighed(*(block[c].to_numpy() for c in ("id", "code", "label")), reach, trees, seed, drawn):
                rest, of = present, np.empty((len(sizes), len(present)), dtype=np.int64)
                for f, size in enumerate(sizes):
                    rest, of[f] = np.divmod(rest, size)
                all_of = np.arange(len(present))
                for t in range(trees):
                    if not len(subsets[t]):
                        continue
                    node = np.zeros(len(present), dtype=np.int64)
                    for _ in range(level):
                        on = split_on[t][node]
                        right = of[np.maximum(on, 0), all_of] > split_at[t][node]
                        node = np.where(on >= 0, 2 * node + 1 + right, node)
                    slot = slots[t][node]
                    open_ = np.flatnonzero(slot >= 0)
                    own, width = slot[open_], subsets[t].shape[1]
                    for j in range(width):
                        cell = (own * width + j) * bins + of[subsets[t][own, j], open_]
                        for k in range(3):
                            totals[t][k] += np.bincount(cell, sums[k, t, open_], totals[t].shape[1])
        if any_rows:
            part = TaskContext.get().partitionId()
            full = [t for t in range(trees) if len(subsets[t])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int64()),
                 pa.array([totals[t].tobytes() for t in full], pa.binary())], schema=_SUMS,
            )

    found = rows.mapInArrow(run, _SUMS_SQL)
    while parts > 1:
        found = found.groupBy("tree", F.floor(F.col("part") / FANIN)).applyInArrow(_added, _SUMS_SQL)
        parts = -(-parts // FANIN)
    return {
        r["tree"]: np.moveaxis(np.frombuffer(r["sums"], dtype=np.float64).reshape(3, *subsets[r["tree"]].shape, bins), 0, -1)
        for r in found.collect()
    }


# -------------------------------------------------------------------------------------- trees


def _binned(train: DataFrame, thresholds: list[np.ndarray], sizes: list[int]) -> DataFrame:
    """Row number, code of the bins and label, written once; the numbers stay with the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            code, unit = np.zeros(b.num_rows, dtype=np.int64), 1
            for f, size in enumerate(sizes):
                code += np.searchsorted(thresholds[f], flat[:, f], side="left") * unit
                unit *= size
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(code), b.column("label")], ["id", "code", "label"])

    path = run_dir(train.sparkSession, "forest")
    numbered = train.select(
        F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("double")
    )
    numbered.mapInArrow(run, "id long, code long, label double").write.parquet(path)
    return train.sparkSession.read.parquet(path)


def _grow(
    rows: DataFrame, thresholds: list[np.ndarray], sizes: list[int], trees: int, depth: int, width: int, seed: int,
    bootstrap: bool,
) -> list[dict[int, dict]]:
    """Per tree its nodes by heap number: ``sums, feature, bin, gain``, the last three for split nodes."""
    features, bins, parts = len(sizes), max(sizes), rows.rdd.getNumPartitions()
    n_splits = np.array([len(x) for x in thresholds])
    nodes: list[dict[int, dict]] = [{} for _ in range(trees)]
    places = (1 << (depth + 1)) - 1
    split_on = np.full((trees, places), -1, dtype=np.int64)
    split_at = np.zeros((trees, places), dtype=np.int64)
    rng, stack = _JavaRandom(seed), [(t, 0) for t in reversed(range(trees))]
    for level in range(depth):
        if not stack:
            break
        # The library takes the nodes from the top of its stack and draws each one's features.
        own: list[list[int]] = [[] for _ in range(trees)]
        drawn: list[list[list[int]]] = [[] for _ in range(trees)]
        for t, node in stack:
            own[t].append(node)
            drawn[t].append(
                _drawn_features(features, width, rng.next_long()) if width < features else list(range(features))
            )
        order = _map_order(list(dict.fromkeys(t for t, _ in stack)))
        slots = np.full((trees, places), -1, dtype=np.int64)
        for t in range(trees):
            slots[t, own[t]] = np.arange(len(own[t]))
        subsets = [np.array(d, dtype=np.int64).reshape(len(d), width) for d in drawn]
        found = _level(rows, parts, sizes, level, split_on, split_at, slots, subsets, bins, seed, bootstrap)
        stack = []
        for t in order:
            place, bin_no, gain = best_splits(found[t], subsets[t], n_splits)
            for i, node in enumerate(own[t]):
                sums = found[t][i, place[i]]
                nodes[t].setdefault(node, {})["sums"] = sums.sum(axis=0)
                if gain[i] <= 0:
                    continue
                feature = int(subsets[t][i, place[i]])
                nodes[t][node] |= {"feature": feature, "bin": int(bin_no[i]), "gain": float(gain[i])}
                split_on[t, node], split_at[t, node] = feature, bin_no[i]
                cut_at = bin_no[i] + 1
                for child, side in ((2 * node + 1, sums[:cut_at]), (2 * node + 2, sums[cut_at:])):
                    nodes[t][child] = {"sums": side.sum(axis=0)}
                    pure = abs(float(_variance(*nodes[t][child]["sums"]))) < 2.220446049250313e-16
                    if level + 1 < depth and not pure:
                        stack.insert(0, (t, child))
    return nodes


def _saved(tree: dict[int, dict], thresholds: list[np.ndarray]) -> list[tuple]:
    """The nodes of a tree as the library writes them: a node before its left branch, that before its right one."""
    def mean(node: int) -> float:
        return float(tree[node]["sums"][1] / tree[node]["sums"][0])

    def merged(node: int) -> None:
        """Two leaves with the same prediction become one."""
        if "feature" in tree[node]:
            pair = (2 * node + 1, 2 * node + 2)
            for child in pair:
                merged(child)
            if not any("feature" in tree[c] for c in pair) and mean(pair[0]) == mean(pair[1]):
                del tree[node]["feature"]

    out: list[tuple] = []

    def write(node: int) -> int:
        own, n = tree[node], len(out)
        stats = [float(x) for x in own["sums"]]
        head = (n, mean(node), float(_variance(*own["sums"])), stats, int(round(stats[0])))
        out.append((*head, -1.0, -1, -1, (-1, [], -1)))
        if "feature" in own:
            split = (own["feature"], [float(thresholds[own["feature"]][own["bin"]])], -1)
            left = write(2 * node + 1)
            out[n] = (*head, own["gain"], left, write(2 * node + 2), split)
        return n

    merged(0)
    write(0)
    return out


_NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def fit_forest(forest: RandomForestRegressor, train: DataFrame, rows: int) -> RandomForestRegressionModel | None:
    """What ``forest`` fits, from ``features`` and ``label`` of ``rows`` training rows; None for too many features.

    A third of the features is drawn per node, as the library does for more than one tree.
    """
    spark = train.sparkSession
    share = min(1.0, 2 * SPLIT_ROWS / rows)
    seed, trees = forest.getSeed(), forest.getNumTrees()
    # Twice the rows and the least of their hashes, so that there are enough.
    sample = train.select("features", "label").withColumn("_id", F.monotonically_increasing_id())
    sample = sample.withColumn("_h", F.xxhash64("_id", F.lit(seed)))
    kept = sample.filter(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("_h").limit(SPLIT_ROWS).collect()
    matrix = np.array([r["features"].toArray() for r in kept])
    thresholds = [split_points(matrix[:, f], forest.getMaxBins()) for f in range(matrix.shape[1])]
    sizes = [len(x) + 1 for x in thresholds]
    if int(np.prod(sizes, dtype=object)) > MAX_CODES:
        return None
    width = -(-len(sizes) // 3) if trees > 1 else len(sizes)
    written = _binned(train, thresholds, sizes)
    grown = _grow(written, thresholds, sizes, trees, forest.getMaxDepth(), width, seed, forest.getBootstrap())

    # The model is the library's own: saved for the few rows, given the nodes, loaded.
    few, path = run_dir(spark, "few"), run_dir(spark, "forest-model")
    slim = train.select("features", F.col("label").cast("double"))
    forest.fit(spark.createDataFrame([(r["features"], float(r["label"])) for r in kept], slim.schema)).save(few)
    spark.read.text(f"{few}/metadata").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{few}/treesMetadata").write.parquet(f"{path}/treesMetadata")
    data = [(t, node) for t, tree in enumerate(grown) for node in _saved(tree, thresholds)]
    spark.createDataFrame(data, _NODES).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
