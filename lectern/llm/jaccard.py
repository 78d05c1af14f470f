"""N-gram Jaccard join: an LSH forest of MinHash prefixes proposes, exact set comparison decides.

1. Every text becomes its set of five-word shingles (hashed) and, for each of ``TREES`` trees, a label of ``FULL_DEPTH``
   minhashes. Texts with equal sets are one class: copies are never compared with each other. A tree is the trie of its
   labels; a node is what labels share as a prefix.
2. Descent: classes meet where they share whole labels. Classes of one node are linked to the node's least class, so a
   node adds as many links as it has classes, whatever its size.
3. The components of these links hold every pair that can be found. Inside a component all pairs of classes are
   compared exactly. A component is cut into blocks, every two blocks are one piece of work, and a piece gives back
   one row per class: how many documents it is linked to, and the least class it is tied to; and how many of its links
   have which similarity.
4. Ascent: from these similarities follows what share of all links a prefix of each depth meets: a pair at s shares a
   prefix of d minhashes in some tree with probability 1 - (1 - s^d)^TREES. If whole labels fall short of ``TARGET``,
   prefixes are shortened in all trees to the longest depth that does not, and step 2 and 3 are done at that depth.
   Data whose copies are close stay at long prefixes, where texts that are only a little alike do not meet. No depth
   below that which the target needs for pairs at the threshold itself is ever used.
5. The components of the verified ties are the groups of near-duplicates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, column, slices, text_of, written
from lectern.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 24
FULL_DEPTH = 8
TARGET = 0.9999
#: Texts and bytes of texts in one block of a component, and in one bin of small components.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
BIN, BIN_BYTES = 2000, 12 << 20
#: Classes of similarity, from the threshold to 1.
BANDS = 20
#: Bits that are kept of each minhash behind the shortest prefix.
TAIL_BITS = 8
CACHE = 200_000
DENSE = 64
SLAB = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, trees: int, full: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


#: The shortest prefix ever used.
LEAST_DEPTH = depth_for(THRESHOLD, TREES, FULL_DEPTH, TARGET)


def meets(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def reached_depth(links: np.ndarray, depth: int = FULL_DEPTH) -> int:
    """The longest prefix that meets the target share of all links, judged by the links met at ``depth``.

    ``links`` counts them by band of similarity. Each stands for one over its chance to be met; a band counts as if
    all its pairs were at its lower end.
    """
    similarity = THRESHOLD + (1 - THRESHOLD) * np.arange(BANDS) / BANDS
    there = links / meets(similarity, depth)
    if not there.sum():
        return depth
    for d in range(depth, LEAST_DEPTH, -1):
        if (there * meets(similarity, d)).sum() >= TARGET * there.sum():
            return d
    return LEAST_DEPTH


def shingler() -> Callable[[str], np.ndarray]:
    """A function from text to its sorted distinct shingle hashes; it remembers a bounded number of words.

    Words stand between ASCII blanks, A-Z in lower case. Fewer than five words are one shingle; none are none.
    """
    known: dict[bytes, int] = {}

    def of(text: str) -> np.ndarray:
        if len(known) > CACHE:
            known.clear()
        out = []
        for word in text.encode("utf-8", "surrogatepass").lower().split():
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            out.append(h)
        if not out:
            return np.zeros(0, np.uint64)
        h = np.array(out, np.uint64)
        size = min(WORDS, len(h))
        total = np.full(len(h) - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                total = (total + h[i : len(h) - size + 1 + i]) * _MIX
                total ^= total >> np.uint64(29)
        return np.unique(total)

    return of


def _permutations(count: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _labels(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per tree a hash of the shortest prefix, and some bits of each minhash behind it, the first one highest."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), SLAB):
            x = shingles[start : start + SLAB, None] * a + b
            least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
        mixed = ((least * _MIX) >> np.uint64(64 - TAIL_BITS)).astype(np.int64).reshape(TREES, FULL_DEPTH)
    prefixes = least.reshape(TREES, FULL_DEPTH)[:, :LEAST_DEPTH]
    nodes = np.array([xxhash.xxh64_intdigest(p.tobytes(), seed=t) for t, p in enumerate(prefixes)], np.uint64)
    places = TAIL_BITS * np.arange(FULL_DEPTH - LEAST_DEPTH - 1, -1, -1)
    return nodes, (mixed[:, LEAST_DEPTH:] << places).sum(axis=1)


def _signed(value: np.ndarray) -> np.ndarray:
    return value.view(np.int64)


SIGNATURES = "doc_id long, text_key long, bytes long, class long, nodes array<long>, tails array<int>"


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles_of, (a, b) = shingler(), _permutations(TREES * FULL_DEPTH)
    none = np.zeros(0, np.int64)
    for batch in slices(batches):
        texts = column(batch, "text")
        sets = [shingles_of(t) for t in texts]
        classes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
        labels = [_labels(s, a, b) if len(s) else (none, none) for s in sets]
        names = ["doc_id", "text_key", "bytes"]
        kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
        nodes = pa.array([_signed(x) for x, _ in labels], pa.list_(pa.int64()))
        tails = pa.array([x.astype(np.int32) for _, x in labels], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(_signed(classes)), nodes, tails], [*names, "class", "nodes", "tails"]
        )


def _sets(texts: list[str], shingles_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their use as places in that list, and the size of every set."""
    sets = [shingles_of(t) for t in texts]
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    return known, at.astype(np.int32), np.array([len(s) for s in sets])


def shared(rows: np.ndarray, columns: np.ndarray, n: int, m: int, split: int) -> np.ndarray:
    """How many columns (shingles) each of the first ``split`` rows shares with each row: int array (split, n).

    Shingles that many rows have are counted by matrix products, slab by slab; the others pair by pair.
    """
    counts = np.bincount(columns, minlength=m)
    out = np.zeros((split, n), np.float32)
    often = np.flatnonzero(counts > DENSE)
    place = np.full(m, -1)
    place[often] = np.arange(len(often))
    for start in range(0, len(often), SLAB):
        at = place[columns] - start
        use = (at >= 0) & (at < SLAB) & (place[columns] >= 0)
        x = np.zeros((n, min(SLAB, len(often) - start)), np.float32)
        x[rows[use], at[use]] = 1
        out += x[:split] @ x.T
    order = np.argsort(columns, kind="stable")
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    flat = out.ravel()
    for size in np.unique(counts[(counts > 1) & (counts <= DENSE)]):
        listed = np.flatnonzero(counts == size)
        for part in np.array_split(listed, max(1, len(listed) * size * size // 4_000_000)):
            users = rows[order[starts[part][:, None] + np.arange(size)]]
            left, right = np.broadcast_arrays(users[:, :, None], users[:, None, :])
            use = left < split
            np.add.at(flat, left[use].astype(np.int64) * n + right[use], 1)
    return out


def _ties(linked: np.ndarray, ids: np.ndarray, split: int) -> np.ndarray:
    """Least class id that each row is tied to through the links (split, n) of these rows."""
    label = ids.copy()
    left, right = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        if (new == label).all():
            return label
        label = new


#: Rows of classes, and rows without a class that count the links (pairs of classes) of a band of similarity.
RESULT = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("tie", pa.int64()), ("band", pa.int32())])


def _compared(ids, weights, columns, sizes, split) -> pa.Table:
    """Links and ties of some classes: the first ``split`` rows with all rows. A row is not linked to itself."""
    n = len(ids)
    rows = np.repeat(np.arange(n), sizes)
    both = shared(rows, columns, n, int(columns.max()) + 1 if len(columns) else 0, split)
    union = sizes[:split, None] + sizes[None, :] - both
    linked = both >= THRESHOLD * union - 1e-6
    linked[np.arange(split), np.arange(split)] = False
    if split < n:  # two different blocks: only what crosses counts
        linked[:, :split] = False
    similar = (both[linked] / union[linked] - THRESHOLD) / (1 - THRESHOLD) * BANDS
    bands = np.bincount(np.clip(similar, 0, BANDS - 1).astype(np.int64), minlength=BANDS)
    bands = bands if split < n else bands // 2
    links = np.zeros(n, np.int64)
    links[:split] = linked @ weights
    if split < n:
        links[split:] = (linked[:, split:].T @ weights[:split]).astype(np.int64)
    ties = _ties(linked, ids, split)
    use = links > 0
    found = [pa.array(ids[use]), pa.array(links[use]), pa.array(ties[use]), pa.nulls(int(use.sum()), pa.int32())]
    used = np.flatnonzero(bands)
    none = pa.nulls(len(used), pa.int64())
    counted = [none, pa.array(bands[used]), none, pa.array(used.astype(np.int32))]
    return pa.concat_tables([pa.Table.from_arrays(x, schema=RESULT) for x in (found, counted)])


def _verify_bin(group: pa.Table) -> pa.Table:
    """Whole components of one block each: all pairs inside each component."""
    shingles_of, out = shingler(), []
    where = np.array(group["component"])
    order = np.argsort(where, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(part) < 2:
            continue
        rows = group.take(pa.array(part))
        _, columns, sizes = _sets(rows["text"].to_pylist(), shingles_of)
        out.append(_compared(np.array(rows["class"]), np.array(rows["size"]), columns, sizes, len(part)))
    return pa.concat_tables(out) if out else RESULT.empty_table()


def _packed(group: pa.Table) -> pa.Table:
    """One block of a large component, packed."""
    known, columns, sizes = _sets(group["text"].to_pylist(), shingler())
    body = pickle.dumps((np.array(group["class"]), np.array(group["size"]), known, columns, sizes))
    body = pa.compress(body, codec="zstd", asbytes=True), len(body)
    first = group.slice(0, 1).select(["component", "block", "blocks"])
    return first.append_column("payload", pa.array([pickle.dumps(body)], pa.binary()))


def _verify_piece(group: pa.Table) -> pa.Table:
    """Two blocks of a component with each other, or one with itself."""
    parts = []
    for i in np.argsort(np.array(group["block"])):
        body, size = pickle.loads(group["payload"][int(i)].as_py())
        parts.append(pickle.loads(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True)))
    ids, weights, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 4))
    if len(parts) == 1:
        if group["low"][0].as_py() != group["high"][0].as_py():
            return RESULT.empty_table()  # the other block has no class
        return _compared(ids, weights, parts[0][3], sizes, len(ids))
    known = np.unique(np.concatenate([p[2] for p in parts]))
    columns = np.concatenate([np.searchsorted(known, p[2])[p[3]] for p in parts])
    return _compared(ids, weights, columns, sizes, len(parts[0][0]))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``group``, ``class_id``, ``group_id``, ``n_links``.

    ``class_id`` and ``group_id`` are the least doc_id of the documents with the same shingles and of the group tied
    by links; ``n_links`` counts the other documents at the threshold or above, copies included. ``text_key`` hashes
    the text and serves to find the row again, ``group`` names the group even where no document of it has an id. Texts without words are alike to each other only. A null key is no
    candidate for an id, so a class of null keys has a null id. Repeated rows are documents of their own.
    """
    body = text_of(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"),
        F.octet_length(body).cast("long").alias("bytes"), body.alias("text"),
    )
    found = written(rows.mapInArrow(_signatures, SIGNATURES), "jaccard-signatures")
    classes = found.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"),
        F.min(F.struct("text_key", "bytes")).alias("one"), F.first("nodes").alias("nodes"), F.first("tails").alias("tails"),
    )
    labels = written(classes.select("class", "class_id", "size", "one.*", "nodes", "tails"), "jaccard-classes")
    classes = labels.drop("nodes", "tails")
    texts = rows.select("text_key", "text")
    verified = _verified(texts, labels, FULL_DEPTH)
    bands = np.zeros(BANDS)
    for row in verified.filter("class IS NULL").groupBy("band").agg(F.sum("links").alias("n")).collect():
        bands[row["band"]] = row["n"]
    if (depth := reached_depth(bands)) < FULL_DEPTH:
        verified = _verified(texts, labels, depth)
    verified = verified.filter("class IS NOT NULL")
    groups = components(verified.select(F.col("class").alias("a"), F.col("tie").alias("b")))
    grouped = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "class_id", "size", F.coalesce("label", "class").alias("label")
    )
    heads = grouped.groupBy("label").agg(F.min("class_id").alias("group_id"))
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    known = grouped.join(heads, "label").join(links, "class", "left")
    known = known.select(
        "class", F.col("label").alias("group"), "class_id", "group_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    known = written(known, "jaccard-groups")
    return found.select("doc_id", "text_key", "class").join(known, "class").select(
        "doc_id", "text_key", "group", "class_id", "group_id", "n_links"
    )


def _verified(texts: DataFrame, labels: DataFrame, depth: int) -> DataFrame:
    """(class, links, tie, band): exact comparison inside the components that prefixes of ``depth`` propose."""
    node = F.xxhash64("p.nodes", F.shiftright("p.tails", TAIL_BITS * (FULL_DEPTH - depth)))
    nodes = labels.select("class", F.explode(F.arrays_zip("nodes", "tails")).alias("p")).select("class", node.alias("node"))
    heads = nodes.groupBy("node").agg(F.min("class").alias("head"), F.max("class").alias("last"))
    heads = written(heads.filter("head <> last").select("node", "head"), "jaccard-nodes")
    edges = nodes.join(heads, "node").select(F.col("class").alias("a"), F.col("head").alias("b"))
    proposed = written(components(edges), "jaccard-proposed")
    known = labels.select("class", "size", "text_key", "bytes").withColumnRenamed("class", "node")
    proposed = written(proposed.join(known, "node"), "jaccard-sizes")
    count = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(count / BLOCK), F.least(F.ceil(F.sum("bytes") / BLOCK_BYTES), count)).cast("long")
    sizes = proposed.groupBy("label").agg(blocks.alias("blocks"))
    members = proposed.join(sizes, "label").select(
        F.col("node").alias("class"), "size", "text_key", F.col("label").alias("component"), "blocks",
        F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).alias("block"),
    )
    # One text per key; copies are combined before they are shuffled.
    one_text = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    members = written(members.join(one_text, "text_key").drop("text_key"), "jaccard-members")
    total = proposed.agg(count.alias("n"), F.sum("bytes").alias("bytes")).first()
    bins = max(64, total["n"] // BIN, (total["bytes"] or 0) // BIN_BYTES)
    result = "class long, links long, tie long, band int"
    small = members.filter("blocks = 1").withColumn("bin", F.pmod(F.xxhash64("component", F.lit(1)), F.lit(bins)))
    small = small.groupBy("bin").applyInArrow(_verify_bin, result)
    packed = members.filter("blocks > 1").groupBy("component", "block").applyInArrow(
        _packed, "component long, block long, blocks long, payload binary"
    )
    # A block takes part in one piece of work with every block of its component.
    pieces = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pieces = pieces.select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "payload"
    )
    large = pieces.groupBy("component", "low", "high").applyInArrow(_verify_piece, result)
    return written(small.union(large), "jaccard-verified")


#: The same over all documents for DuckDB, every pair with a common shingle compared.
SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + {WORDS - 1}], ' ') AS shingle
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y, nx.n = common AND ny.n = common AS same FROM pairs JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y
          WHERE common >= {THRESHOLD} * (nx.n + ny.n - common) - 1e-6
          UNION ALL SELECT a.r, b.r, true FROM d a JOIN d b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.r <> b.r),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
alike AS (SELECT x, min(doc_id) AS least FROM links JOIN d ON d.r = y WHERE same GROUP BY x),
tied AS (SELECT x, min(doc_id) AS least FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, least(doc_id, alike.least) AS class_id, least(doc_id, tied.least) AS group_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN counts ON counts.x = r LEFT JOIN alike ON alike.x = r LEFT JOIN tied ON tied.x = r"""


def op1(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "class_id", "group_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id`` and ``text``) that stay when one document of each group is kept.

    The one with the least doc_id stays; among rows with that id one of its texts, and of repeated rows one.
    """
    found = join(docs)
    heads = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("h"))
    keep = heads.select(F.col("h.doc_id").alias("_id"), F.col("h.text_key").alias("_key"))
    key_of, id_of = (next(n for n in _names(name) if n not in docs.columns) for name in ("key_of", "id_of"))
    keyed = docs.withColumn(key_of, F.xxhash64(text_of())).withColumn(id_of, F.col("doc_id"))
    kept = keyed.join(keep, (F.col(key_of) == F.col("_key")) & F.col(id_of).eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates([key_of, id_of]).drop(key_of, id_of)


def _names(name: str) -> Iterator[str]:
    while True:
        name = f"_{name}"
        yield name
