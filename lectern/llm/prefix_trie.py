"""Prefix trie of conversations, from fingerprints that compose.

A sequence of turns has the fingerprint ``v -> v * B + turn`` taken over its turns, modulo a prime, for two random
bases. Such maps form a monoid: the fingerprint of a sequence follows from those of its parts and their lengths. So

1. the turns of a conversation need not meet in one task: sorted runs compute products of their own, and what a
   conversation has gathered in the runs before is multiplied on afterwards;
2. a rebuilt conversation (the head of its base, then its own later turns) is never put together: the fingerprint of
   its prefix is ``head * B^k + own - start * B^k``, where ``start`` is its own product up to the cut.

Prefixes with the same depth and fingerprint are one node. Equality is verified, not assumed: every row keeps the
fingerprint of the prefix before it and a reference to its last turn, all rows of a node must agree in both, and all
turns behind one reference must have the same role and text. If any does not, everything is done again with other
bases.

A node belongs to its smallest member. The nodes a conversation owns are the lower end of its path, so sums over
subtrees need one number per conversation, added to the nodes above that end, and a running sum along it. No step
walks the trie level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, column, text_of, written

#: Conversations of one family share a base: the first of each ``FAMILY`` ids.
FAMILY = 20
#: A head has less than ``HEADS`` turns.
HEADS = 4
PRIME = (1 << 61) - 1
#: Depths that are summed in one window; deeper paths are summed block by block.
BLOCK = 65_536
TRIES = 5
EMPTY = hashlib.sha256(b"").hexdigest()


class Bases:
    """The two bases of one attempt and their powers."""

    def __init__(self, seed: int):
        self.values = [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:7], "big") for i in range(2)]
        self.known: dict[int, tuple[int, int]] = {}

    def power(self, n: int) -> tuple[int, int]:
        found = self.known.get(n)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[n] = tuple(pow(b, n, PRIME) for b in self.values)
        return found


LOCAL = (
    "part int, summary boolean, conv_id long, pos long, v1 long, v2 long, w1 long, w2 long, k1 long, k2 long, words long"
)
TURNS = "conv_id long, pos long, v1 long, v2 long, w1 long, w2 long, k1 long, k2 long, words long"


def _batch(rows: list[tuple], names: list[str], kinds: dict) -> pa.RecordBatch:
    arrays = [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _runs(seed: int):
    """Products along each sorted run, and at its end what its first and last conversation have gathered in it."""
    names, kinds = [c.split()[0] for c in LOCAL.split(", ")], {"part": pa.int32(), "summary": pa.bool_()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (x, y) = TaskContext.get().partitionId(), Bases(seed).values
        conv, pos, a, b, first, ends = None, 0, 0, 0, None, []
        for batch in batches:
            out = []
            for c, k1, k2, words in zip(*[column(batch, n) for n in ("conv_id", "k1", "k2", "words")], strict=True):
                if c != conv:
                    if first is None and conv is not None:
                        first = conv
                        ends.append((part, True, conv, pos, a, b, 0, 0, 0, 0, 0))
                    conv, pos, a, b = c, 0, 0, 0
                before = a, b
                pos += 1
                a, b = (a * x + k1 % PRIME + 1) % PRIME, (b * y + k2 % PRIME + 1) % PRIME
                out.append((part, False, c, pos, a, b, *before, k1, k2, words))
            if out:
                yield _batch(out, names, kinds)
        if conv is not None:
            ends.append((part, True, conv, pos, a, b, 0, 0, 0, 0, 0))
            yield _batch(ends, names, kinds)

    return run


def _carries(ends: list, bases: Bases) -> dict[int, tuple]:
    """What the first conversation of each run had gathered in the runs before: part -> (conv_id, turns, products)."""
    out, by_part = {}, {}
    for r in ends:
        by_part.setdefault(r["part"], []).append(r)
    held = None  # the conversation at the end of the runs so far
    for part in sorted(by_part):
        rows = sorted(by_part[part], key=lambda r: r["conv_id"])
        first, last = rows[0], rows[-1]
        if held is not None and held[0] == first["conv_id"]:
            out[part] = held
            p, q = bases.power(first["pos"])
            joined = (
                first["conv_id"], held[1] + first["pos"],
                (held[2] * p + first["v1"]) % PRIME, (held[3] * q + first["v2"]) % PRIME,
            )
        else:
            joined = first["conv_id"], first["pos"], first["v1"], first["v2"]
        held = joined if last is first else (last["conv_id"], last["pos"], last["v1"], last["v2"])
    return out


def _carried(carries: dict[int, tuple], seed: int):
    names = [c.split()[0] for c in TURNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = Bases(seed)
        for batch in batches:
            out = []
            for part, c, pos, v1, v2, w1, w2, k1, k2, words in zip(
                *[column(batch, n) for n in ("part", *names)], strict=True
            ):
                held = carries.get(part)
                if held is not None and held[0] == c:
                    (p, q), (r, s) = bases.power(pos), bases.power(pos - 1)
                    v1, v2 = (held[2] * p + v1) % PRIME, (held[3] * q + v2) % PRIME
                    w1, w2 = (held[2] * r + w1) % PRIME, (held[3] * s + w2) % PRIME
                    pos += held[1]
                out.append((c, pos, v1, v2, w1, w2, k1, k2, words))
            if out:
                yield _batch(out, names, {})

    return run


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn with its position, its prefix's fingerprint (v), that of the prefix before (w) and its reference (k)."""
    texts = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"),
        text_of().alias("text"),
    )
    keyed = texts.select(
        "*", F.xxhash64("role", "text", F.lit(seed)).alias("k1"), F.xxhash64(F.lit(seed), "text", "role").alias("k2"),
        F.regexp_count("text", F.lit(f"({WORD})")).cast("long").alias("words"),
    )
    # Equal turns have equal references; that unequal ones differ is checked.
    named = keyed.groupBy("k1", "k2", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    clash = named.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if clash.limit(1).count():
        raise Collision
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    # The start of a text is enough to tell runs apart; within one they are sorted by all of it.
    dealt = keyed.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    local = written(dealt.select("conv_id", "k1", "k2", "words").mapInArrow(_runs(seed), LOCAL), "trie-runs")
    # Two rows of each run; a run is one task.
    ends = local.filter("summary").collect()
    body = local.filter(~F.col("summary")).drop("summary")
    return body.mapInArrow(_carried(_carries(ends, Bases(seed)), seed), TURNS)


class Collision(Exception):
    """Two different prefixes or turns have the same fingerprint."""


JOINED = "conv_id long, depth long, v1 long, v2 long, w1 long, w2 long, k1 long, k2 long, words long, last boolean"


def _joined(seed: int):
    """Fingerprints of rebuilt prefixes that end behind the head, combined from those of the head and of the turns."""
    names = [c.split()[0] for c in JOINED.split(", ")]
    asked = ("conv_id", "pos", "cut", "head", "length", "v1", "v2", "w1", "w2", "k1", "k2", "words", "d1", "d2")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = Bases(seed)
        for batch in batches:
            out = []
            for c, pos, cut, head, length, v1, v2, w1, w2, k1, k2, words, d1, d2 in zip(
                *[column(batch, n) for n in asked], strict=True
            ):
                (p, q), (r, s), depth = bases.power(pos - cut), bases.power(pos - cut - 1), head + pos - cut
                out.append((
                    c, depth, (d1 * p + v1) % PRIME, (d2 * q + v2) % PRIME, (d1 * r + w1) % PRIME,
                    (d2 * s + w2) % PRIME, k1, k2, words, depth == length,
                ))
            if out:
                yield _batch(out, names, {"last": pa.bool_()})

    return run


def _prefixes(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and the rebuilt lengths (conv_id, length)."""
    at = F.struct("pos", "v1", "v2", "w1", "w2", "k1", "k2", "words")
    own = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, at))).alias("own")
    )
    own = own.select(
        "*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("cut"),
    )
    own = written(own, "trie-conversations")
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    known = own.join(bases, "base", "left").select(
        "conv_id", "n", "own", "cut",
        F.slice(F.coalesce("base_turns", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("cut")).alias("heads"),
    )
    known = known.select(
        "*", F.size("heads").cast("long").alias("head"),
        (F.size("heads") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).cast("long").alias("length"),
    )
    known = written(known, "trie-rebuilt")

    def value(name: str, array: str, place: str):
        return F.coalesce(F.get(F.col(array), F.col(place) - 1)[name], F.lit(0))

    # Head minus start: what a power of the base multiplies.
    starts = known.filter("n > cut").select(
        "conv_id", F.col("cut").cast("long").alias("cut"), "head", "length",
        *[(value(v, "heads", "head") - value(v, "own", "cut")).alias(d) for v, d in (("v1", "d1"), ("v2", "d2"))],
    )
    rest = turns.join(starts.hint("merge"), "conv_id").filter("pos > cut").mapInArrow(_joined(seed), JOINED)
    heads = known.select("conv_id", "length", F.explode(F.transform("heads", lambda x: x)).alias("h")).select(
        "conv_id", F.col("h.pos").alias("depth"), "h.v1", "h.v2", "h.w1", "h.w2", "h.k1", "h.k2", "h.words",
        (F.col("h.pos") == F.col("length")).alias("last"),
    )
    return written(heads.unionByName(rest), "trie-prefixes"), known.select("conv_id", "length")


def _ends_hashed(keys: list[str]):
    """SHA-256 of the ids of each node, ascending and joined by commas, from rows sorted by node and id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, conv in zip(*[column(batch, n) for n in (*keys, "conv_id")], strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield _batch(done, [*keys, "ends_sha256"], {"ends_sha256": pa.string()})
        if node is not None:
            yield _batch([(*node, state.hexdigest())], [*keys, "ends_sha256"], {"ends_sha256": pa.string()})

    return run


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A node that very many conversations end in is one task, as SHA-256 goes on from id to id; it holds one row."""
    dealt = rows.select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id")
    return dealt.mapInArrow(_ends_hashed(keys), ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


NODE = ["depth", "v1", "v2"]


def _nodes(prefixes: DataFrame) -> DataFrame:
    """One row per distinct prefix; raises if any two prefixes taken for one differ."""
    told = ["w1", "w2", "k1", "k2"]
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.min(c).alias(c) for c in told], *[F.max(c).alias(f"{c}_max") for c in told],
    )
    nodes = written(nodes, "trie-nodes")
    if nodes.filter(" OR ".join(f"{c} <> {c}_max" for c in told)).limit(1).count():
        raise Collision
    return nodes.drop(*[f"{c}_max" for c in told]).withColumn("weight", (F.col("n_convs") - 1) * F.col("words"))


def _suffix_sums(nodes: DataFrame) -> DataFrame:
    """For every node the weights of the nodes at or below it that its owner owns, as ``below``."""
    block = F.floor(F.col("depth") / BLOCK).cast("long")
    blocked = nodes.withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    summed = blocked.withColumn("below", F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Blocks further down; there are none unless a path is longer than a block.
    totals = blocked.filter("block > 0").groupBy("conv_id", "block").agg(F.sum("weight").alias("weight"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    later = totals.select(
        "conv_id", (F.col("block") - 1).alias("block"),
        F.sum("weight").over(deeper.rowsBetween(Window.unboundedPreceding, 0)).alias("later"),
    )
    summed = summed.join(later, ["conv_id", "block"], "left")
    return summed.withColumn("below", F.col("below") + F.coalesce("later", F.lit(0))).drop("block", "later")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, of the rebuilt conversations.

    Turns stand in the order of ``turn`` (null first), then of role and text; a null role or text is empty. Repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation. Texts of any length are hashed
    whole. Other columns are not read. An empty table has no node, not even a root.
    """
    for seed in range(TRIES):
        try:
            return _trie(conversations, seed)
        except Collision:
            continue
    raise RuntimeError(f"fingerprints collided under {TRIES} pairs of bases")


def _trie(conversations: DataFrame, seed: int) -> DataFrame:
    turns = written(_turns(conversations, seed), "trie-turns")
    prefixes, lengths = _prefixes(turns, seed)
    nodes = _nodes(prefixes)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(_suffix_sums(nodes), "trie-owned")
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.sum("weight").alias("owned"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
    )
    owners = written(owners, "trie-owners")
    # What conversations own further down counts for every node above that they run through.
    above = prefixes.join(owners.hint("merge"), "conv_id").filter(F.col("depth") < F.col("first"))
    above = above.groupBy(*NODE).agg(F.sum("owned").alias("others"), F.sum("leaf").alias("other_leaves"))
    ends = _hashed(prefixes.filter("last"), NODE)
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("v1").alias("w1"), F.col("v2").alias("w2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    top = owners.agg(F.sum("owned").alias("saved"), F.sum("leaf").alias("leaves")).first()
    first = nodes.filter("depth = 1").count()
    named = nodes.join(above, NODE, "left").join(ends, NODE, "left")
    # Nodes of depth 1 have the root for parent; the others meet theirs.
    deep = named.filter("depth > 1").join(parents.hint("merge"), ["depth", "w1", "w2"])
    flat = named.filter("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("long"))
    owner = owners.select("conv_id", "leaf")
    out = deep.unionByName(flat).join(owner, "conv_id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("other_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("below") + F.coalesce("others", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    if not root["n_convs"]:
        return out
    spark = conversations.sparkSession
    turnless = _hashed(lengths.filter("length = 0").withColumn("depth", F.lit(0).cast("long")), ["depth"])
    line = spark.createDataFrame(
        [(root["conv_id"], 0, None, root["n_convs"], first, top["leaves"] or 1, top["saved"] or 0)],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    line = line.join(turnless, "depth", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.unionByName(line)


#: The same for DuckDB, over rebuilt lists of turns.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
      list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS own,
      xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b:
        list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
          lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % {HEADS} AS cut
      FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : c.cut], c.own[c.cut + 1 :]) AS seq
      FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
p AS (SELECT conv_id, d, seq[1 : d] AS prefix, d = len(seq) AS last
      FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS (SELECT row_number() OVER () AS node, * FROM (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM p GROUP BY d, prefix)),
m AS (SELECT p.conv_id, p.d, n.node FROM p JOIN n ON p.d = n.d AND p.prefix = n.prefix),
kids AS (SELECT up.node, count(*) AS n_children FROM n JOIN n AS up ON up.d = n.d - 1 AND up.prefix = n.prefix[1 : n.d - 1]
         GROUP BY up.node),
w AS (SELECT n.node, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE
      (n_convs - 1) * len(regexp_extract_all(prefix[d].text, '{WORD}')) END AS weight FROM n LEFT JOIN kids ON kids.node = n.node),
below AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT top, sum(weight) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
         FROM below JOIN w ON w.node = below.node GROUP BY top)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, w.n_children::BIGINT AS n_children,
       sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN w ON w.node = n.node JOIN sums ON sums.top = n.node
LEFT JOIN n AS up ON up.d = n.d - 1 AND up.prefix = n.prefix[1 : n.d - 1]"""


def op13(conversations: DataFrame) -> DataFrame:
    return trie(conversations)
