"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the sources share a multiple of all words by weight, none above a multiple of its own size. The targets are
met in blocks of ``block`` words: blocks go to sources by the highest quotients target / (2j - 1), a source's blocks
go to groups of its shards and then to the shards in the same way, which gives every shard an integer quota. A
shard's documents lie end to end in seeded order; its stream is cut into blocks and the blocks with the lowest seeded
hashes are taken. A document's share is the part of the taken blocks that lies in it. Equal rows are counted first and
every copy draws a shard of its own, so that many copies do not fill one shard.

Texts are read once, to count their words. Everything after that works on (key, source, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.bounded import broadcast_if_small
from lectern.functions.binding import once
from lectern.llm.common import WORD, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 64
SHARD_WORDS = 1 << 18
#: Copies of a row that are listed at a time.
COPIES = 4096
SEED = 20


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS):
    """Per source (columns ``source``, ``source_size``): its ``target``.

    Sources by code point, null last, take the weights in turn. Where every source that would pass its limit
    ``repeats * size`` is held there, the others get one common multiple of their weights. Sorted by limit / weight,
    the held ones come first: the first source that need not be held fixes the multiple. One row per source only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    rows = sizes.withColumn("weight", turn).withColumn("limit", F.col("source_size").cast("double") * repeats)
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy(F.lit(1))
    held = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("all", F.sum("source_size").over(whole) * F.lit(share))
    rows = rows.withColumn("multiple", (F.col("all") - held) / open_weight)
    fits = F.when(F.col("multiple") <= F.col("limit") / F.col("weight"), F.struct("limit", "multiple", "weight"))
    first = F.min(
        F.when(fits.isNotNull(), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("multiple")))
    ).over(whole)
    common = F.coalesce(first["multiple"], F.lit(float("inf")))
    target = F.least(F.col("limit"), F.when(F.col("limit") > 0, common * F.col("weight")).otherwise(0.0))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(units: DataFrame, by: list[str], unit: str, size: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the seats each unit gets out of its group's ``seats`` by the Sainte-Lague quotients of ``size``.

    A divisor slightly too large gives every unit a number of seats it surely gets, one slightly too small a number it
    surely does not pass; the two differ by about two a unit. Only the quotients in between are ranked, ties by unit.
    Units without size get nothing.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    wide = units.withColumn("_all", F.sum(F.col(size).cast("double")).over(group)).withColumn(
        "_units", F.count(F.when(F.col(size) > 0, 1)).over(group)
    )
    part = F.when(F.col("_all") > 0, F.col(size) / F.col("_all")).otherwise(0.0)
    sure = F.greatest(F.floor(part * (F.col(seats) - F.col("_units") / 2) + 0.5) - 1, F.lit(0))
    most = F.floor(part * (F.col(seats) + F.col("_units") / 2) + 0.5) + 1
    wide = wide.withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long"))
    wide = wide.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    wanted = F.when(F.col(size) > 0, F.sequence(F.col("_sure") + 1, F.col("_most"))).otherwise(
        F.array(F.lit(None).cast("long"))
    )
    tried = wide.withColumn("_j", F.explode(once(wanted)))
    quotient = F.col(size) / (2 * F.col("_j") - 1)
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    tried = tried.withColumn(
        "_rank", F.row_number().over(order.orderBy(quotient.desc_nulls_last(), F.col(unit).asc_nulls_last(), "_j"))
    )
    taken = F.count(F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_left")), 1))
    names = [c for c in units.columns]
    return (
        tried.groupBy(*names, "_sure").agg(taken.alias("_more")).withColumn(out, F.col("_sure") + F.col("_more"))
        .drop("_sure", "_more")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts words with repeats, at most ``repeats`` times the size. Null sources are one source of their
    own; a null or empty text has size 0 and nothing is taken; repeated rows are documents of their own. An empty
    table gives an empty result. The last block of a shard may be short, so a source can miss its target by a block
    per shard of ``SHARD_WORDS`` words. The order inside a shard comes from a hash of key, text and the number of the
    copy, so reruns agree. A text longer than a shard makes its shard longer, never splits.
    """
    body = text_of(text)
    slim = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), count_words(body).alias("size"),
        _number(F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body), F.lit(seed)).alias("h"),
    )
    slim = written(number_copies(slim, seed), "mix-sizes")
    return mix_sizes(slim, weights, share, repeats, block, seed)


def number_copies(slim: DataFrame, seed: int = SEED) -> DataFrame:
    """Gives every copy of a row after the first its own ``h``; tasks add up their copies before the shuffle."""
    columns = slim.columns
    counted = slim.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    runs = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))
    run = counted.withColumn("_run", F.explode(once(runs)))
    copies = F.sequence(F.col("_run"), F.least(F.col("_run") + COPIES, F.col("_copies")) - 1)
    each = run.withColumn("_copy", F.explode(once(copies)))
    h = F.when(F.col("_copy") == 0, F.col("h")).otherwise(_number(F.col("h"), F.col("_copy"), F.lit(seed)))
    return each.withColumn("h", h).select(*columns)


def _key(source: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix_sizes(slim: DataFrame, weights, share: float, repeats: int, block: int, seed: int) -> DataFrame:
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, repeats)
    words = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    sources = sources.withColumn("_seats", F.floor(words * F.lit(share) / block + 0.5).cast("long"))
    sources = apportion(sources, [], "source", "target", "_seats", "seats")
    # A source's shards hold about SHARD_WORDS words each; groups of shards keep every apportionment small.
    shards = F.ceil(F.col("source_size") / SHARD_WORDS).cast("long")
    sources = sources.select(
        _key(F.col("source")).alias("k"), "source_size", "target", "seats", F.greatest(shards, F.lit(1)).alias("shards")
    )
    sources = sources.withColumn("groups", F.ceil(F.sqrt(F.col("shards"))).cast("long"))
    few = broadcast_if_small(sources)
    keyed = slim.withColumn("k", _key(F.col("source")))
    # Rows without words take nothing; in no shard, they cannot crowd one.
    empty = keyed.filter(F.col("size") == 0).join(few, "k").withColumn("taken", F.lit(0).cast("long"))
    placed = keyed.filter(F.col("size") > 0).join(few, "k")
    placed = placed.withColumn("shard", F.pmod(F.col("h"), F.col("shards"))).withColumn(
        "g", F.col("shard") % F.col("groups")
    )
    by_shard = placed.groupBy("k", "g", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    by_group = by_shard.groupBy("k", "g").agg(F.sum("words").alias("group_words"), F.first("seats").alias("seats"))
    by_group = apportion(by_group, ["k"], "g", "group_words", "seats", "group_seats").select("k", "g", "group_seats")
    quota = by_shard.drop("seats").join(by_group, ["k", "g"])
    quota = apportion(quota, ["k", "g"], "shard", "words", "group_seats", "quota")
    blocks = F.ceil(F.col("words") / block).cast("long")
    quota = quota.select(
        F.col("k").alias("qk"), F.col("shard").alias("qs"), blocks.alias("blocks"),
        F.least(F.col("quota"), blocks * repeats).alias("quota"),
    )
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    rest = F.col("quota") - rounds * F.col("blocks")
    ranked = F.array_sort(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: _draw(F.col("qk"), F.col("qs"), b, seed))
    )
    quota = quota.select("qk", "qs", rounds.alias("rounds"), F.when(rest > 0, F.get(ranked, (rest - 1).cast("int"))).alias("last"))
    order = W.partitionBy("k", "shard").orderBy("h", F.col("doc_id").asc_nulls_last(), "size")
    stream = placed.withColumn("stop", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    stream = stream.withColumn("start", F.col("stop") - F.col("size"))
    joined = stream.join(quota, (F.col("k") == F.col("qk")) & (F.col("shard") == F.col("qs")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)

    def part(b):
        inside = F.least((b + 1) * block, F.col("stop")) - F.greatest(b * block, F.col("start"))
        return F.when(_draw(F.col("k"), F.col("shard"), b, seed) <= F.col("last"), inside).otherwise(0)

    extra = F.aggregate(F.transform(F.sequence(first, last), part), F.lit(0).cast("long"), lambda a, x: a + x)
    taken = F.col("rounds") * F.col("size") + F.when(F.col("last").isNotNull(), extra).otherwise(0)
    out = ["doc_id", "source", "size", "source_size", "target"]
    return joined.select(*out, taken.cast("long").alias("taken")).unionByName(empty.select(*out, "taken"))


def _draw(source: Column, shard: Column, block: Column, seed: int) -> Column:
    """The seeded number by which a shard's blocks are drawn, lowest first."""
    return _number(source, shard, block, F.lit(seed))


def _number(*parts: Column) -> Column:
    """Sixty bits drawn by hash from the parts, the same in every engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _seats_sql(units: str, by: str, unit: str, size: str, seats: str) -> str:
    """Rows of ``units`` with ``got``: every quotient ranked, the first ``seats`` of each group taken."""
    over = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT u.*, coalesce(q.got, 0) AS got FROM {units} u LEFT JOIN (
      SELECT {by + ',' if by else ''} {unit}, count(*) AS got FROM (
        SELECT *, row_number() OVER ({over}ORDER BY {size} / (2 * j - 1) DESC, {unit} NULLS LAST, j) AS place FROM (
          SELECT *, unnest(range(1, 3 + CAST(ceil(CAST({size} AS DOUBLE) / whole * ({seats} + n / 2.0)) AS BIGINT))) AS j FROM (
            SELECT *, sum(CAST({size} AS DOUBLE)) OVER ({over}) AS whole, count(*) OVER ({over}) AS n FROM {units} WHERE {size} > 0)))
      WHERE place <= {seats} GROUP BY {by + ',' if by else ''} {unit}) q
      ON u.{unit} IS NOT DISTINCT FROM q.{unit} {' '.join(f'AND u.{b} = q.{b}' for b in by.split(', ') if b)})"""


def _number_sql(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


#: The same over all documents, for DuckDB.
SQL = f"""
WITH slim AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    {_number_sql("coalesce(CAST(doc_id AS VARCHAR), '')", "md5(coalesce(text, ''))", str(SEED))} AS h,
    coalesce('=' || source, '') AS k FROM documents),
sizes AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY ALL),
weighed AS (SELECT *, [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
    CAST(source_size AS DOUBLE) * {REPEATS} AS most FROM sizes),
tried AS (SELECT *, most / weight AS ratio, ((SELECT sum(source_size) FROM sizes) * {SHARE}::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS multiple FROM weighed),
targets AS (SELECT source, k, source_size, CASE WHEN most > 0 THEN least(most, weight * coalesce(
    (SELECT multiple FROM tried WHERE multiple <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 'inf'::DOUBLE)) ELSE 0.0 END AS target,
    CAST(floor((SELECT sum(source_size) FROM sizes) * {SHARE}::DOUBLE / {BLOCK} + 0.5) AS BIGINT) AS seats,
    greatest(CAST(ceil(source_size / {SHARD_WORDS}.0) AS BIGINT), 1) AS shards FROM tried),
sources AS (SELECT *, CAST(ceil(sqrt(shards)) AS BIGINT) AS groups FROM {_seats_sql('targets', '', 'source', 'target', 'seats')}),
placed AS (SELECT s.*, t.source_size, t.target, t.got, s.h % t.shards AS shard, s.h % t.shards % t.groups AS g
           FROM slim s JOIN sources t USING (k)),
by_shard AS (SELECT k, g, shard, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY ALL),
by_group AS (SELECT k, g, CAST(sum(size) AS BIGINT) AS words, any_value(got) AS seats FROM placed GROUP BY ALL),
of_group AS (SELECT k, g, got AS seats FROM {_seats_sql('by_group', 'k', 'g', 'words', 'seats')}),
shard_units AS (SELECT b.*, o.seats FROM by_shard b JOIN of_group o USING (k, g)),
quota AS (SELECT k, shard, blocks, least(got, {REPEATS} * blocks) AS quota FROM (
    SELECT *, CAST(ceil(words / {BLOCK}.0) AS BIGINT) AS blocks FROM {_seats_sql('shard_units', 'k, g', 'shard', 'words', 'seats')})),
rounds AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS rest FROM quota),
drawn AS (SELECT k, shard, b, {_number_sql('k', 'shard', 'b', str(SEED))} AS draw FROM (SELECT k, shard, unnest(range(blocks)) AS b FROM quota)),
taken AS (SELECT k, shard, b, place <= rest AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY k, shard ORDER BY draw) AS place FROM drawn) JOIN rounds USING (k, shard)),
stream AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k, shard ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM placed),
parts AS (SELECT doc_id, h, k, shard, size, sum(least((b + 1) * {BLOCK}, stop) - greatest(b * {BLOCK}, stop - size)) FILTER (more) AS extra
    FROM (SELECT *, unnest(range((stop - size) // {BLOCK}, (stop - 1) // {BLOCK} + 1)) AS b FROM stream WHERE size > 0)
    JOIN taken USING (k, shard, b) GROUP BY ALL)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(r.rounds * s.size + coalesce(p.extra, 0) AS BIGINT) AS taken
FROM stream s JOIN rounds r USING (k, shard) LEFT JOIN parts p ON p.k = s.k AND p.shard = s.shard AND p.h = s.h AND p.doc_id = s.doc_id"""


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
