"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph is hashed to a wide vector and a document's fingerprint is the sum of those vectors: ``EXACT`` words
modulo 2^32 that decide equality, and ``LANES`` signed counters modulo 2^16 (one of them moved by one per paragraph)
that allow a likeness. Addition does not mind the order, and a paragraph is put in or taken out by adding or
subtracting its vector (``insert`` and ``delete``); no other paragraph has to be read again.

All of it is array expressions on the row. The next document's text reaches a row by one shuffle of the table into
ranges of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.binding import let, once
from lectern.llm.common import text_of

EXACT = 8
MODULUS = 1 << 32
LANES = 64
#: Paragraphs end at line ends; within a line also after a mark that ends or divides a sentence.
BREAK = r"[\r\n]+|(?<=[.!?;,:|])\x20+"
ROWS_PER_RANGE = 1000
MAX_RANGES = 20_000
FANOUT = 32


def paragraphs(text: Column) -> Column:
    """Paragraphs without blank ends; empty ones do not count."""
    return F.filter(F.transform(F.split(text, BREAK), lambda p: F.trim(p)), lambda p: p != "")


def _wrap(value: Column) -> Column:
    """A sum of lanes back in the range of a signed 16-bit counter."""
    return (F.pmod(value + 32768, F.lit(65536)) - 32768).cast("short")


def _words(paragraph: Column) -> Column:
    """The hash of a paragraph as ``EXACT`` words of 32 bits."""

    def words(digest):
        return F.transform(
            F.sequence(F.lit(0), F.lit(EXACT - 1)),
            lambda j: F.conv(F.substring(digest, j * 8 + 1, F.lit(8)), 16, 10).cast("long"),
        )

    return let(F.sha2(paragraph, 256), words)


def _vector(hashed: Column) -> Column:
    """The sum of the vectors behind the paragraphs' words; the first word also draws a lane and a sign."""
    codes = F.transform(hashed, lambda w: (F.get(w, F.lit(0)) % (2 * LANES)).cast("int"))

    def exact(j):
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, w: a + F.get(w, j)) % MODULUS

    def lanes(codes):
        def lane(j):
            up = F.size(F.filter(codes, lambda c: c == j))
            down = F.size(F.filter(codes, lambda c: c == j + LANES))
            return _wrap(up - down)

        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane)

    return F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), exact).alias("exact"), let(codes, lanes).alias("lanes")
    )


def vector(text: Column) -> Column:
    """Fingerprint of a text as struct<exact: array<bigint>, lanes: array<smallint>>."""
    return let(F.transform(paragraphs(text), _words), _vector)


def _combined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS))).alias("exact"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: _wrap(x.cast("int") + sign * y.cast("int"))).alias("lanes"),
    )


def insert(fingerprint: Column, added: Column) -> Column:
    """Fingerprint after paragraphs with the vector ``added`` were put in, anywhere."""
    return _combined(fingerprint, added, 1)


def delete(fingerprint: Column, removed: Column) -> Column:
    """Fingerprint after paragraphs with the vector ``removed`` were taken out."""
    return _combined(fingerprint, removed, -1)


def shown(vector: Column) -> Column:
    """The vector as text: hexadecimal words, then the lanes in hexadecimal."""
    words = F.transform(vector["exact"], lambda w: F.lpad(F.hex(w), 8, "0"))
    lanes = F.transform(vector["lanes"], lambda c: F.lpad(F.hex(F.pmod(c.cast("int"), F.lit(65536))), 4, "0"))
    return F.lower(F.concat(F.array_join(words, ""), F.array_join(lanes, "")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the lanes, no less than 0 and below 1."""

    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(a["lanes"], a["lanes"]) * dot(b["lanes"], b["lanes"]))
    cosine = F.when(size > 0, dot(a["lanes"], b["lanes"]) / size).otherwise(0.0)
    return F.when(a["exact"] == b["exact"], 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(0.999999)))


def _numbers(values: list, kind: str = "bigint") -> Column:
    """A literal array, made from one string, since a literal per number is slow to build."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _bounds(docs: DataFrame, key: str) -> list[int]:
    """Keys that end the ranges, ascending; each is a key of the table, the last is the largest.

    The driver gets at most one number per range.
    """
    ranges = max(1, min(MAX_RANGES, docs.select(key).count() // ROWS_PER_RANGE))
    shares = _numbers([i / ranges for i in range(1, ranges + 1)], "double")
    found = docs.agg(F.percentile_approx(key, shares, F.lit(10 * ranges + 1000)).alias("b"), F.max(key).alias("top"))
    found = found.first()
    return [] if found["top"] is None else sorted({*found["b"], found["top"]})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key, looked up in two steps; a null key belongs to range 0."""
    known, coarse = _numbers(bounds), _numbers(bounds[FANOUT - 1 :: FANOUT])

    def below(values):
        return F.size(F.filter(values, lambda b: b < key))

    at = let(below(coarse), lambda g: g * FANOUT + below(F.slice(known, g * FANOUT + 1, F.lit(FANOUT))))
    return F.when(key.isNull(), 0).otherwise(at)


def with_next(docs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key`` and ``values``, and as ``next_*`` the values of the next row by descending key; last comes the first.

    One shuffle into ranges of the key. The row with a range's largest key is also sent to the range above it, which
    it ends, so no window runs over all rows. Rows with equal keys follow each other by their values; null keys come
    last and share the lowest range. An empty table stays empty; a single row is its own next one.
    """
    bounds = _bounds(docs.select(key), key)
    rows = docs.select(key, *values).withColumn("_range", _range_of(F.col(key), bounds))
    own, top = F.col("_range"), len(bounds) - 1
    above = F.struct(F.when(own == top, 0).otherwise(own + 1).alias("at"), F.lit(True).alias("sent"))
    here = F.struct(own.alias("at"), F.lit(False).alias("sent"))
    if bounds:
        largest = F.col(key) == F.get(_numbers(bounds), own)
        places = F.when(largest, F.array(here, above)).otherwise(F.array(here))
    else:
        places = F.array(here)
    rows = rows.withColumn("_place", F.explode(once(places)))
    order = [F.col("_place.sent"), F.col(key).desc_nulls_last(), *[F.col(v) for v in values]]
    by_range = W.partitionBy("_place.at").orderBy(*order)
    following = F.lead(F.struct(*values)).over(by_range)
    if not bounds:  # only null keys: one range, and its first row follows its last
        following = F.coalesce(following, F.first(F.struct(*values)).over(by_range))
    rows = rows.withColumn("_next", following).filter(~F.col("_place.sent"))
    return rows.select(key, *values, *[F.col("_next")[v].alias(f"next_{v}") for v in values])


def _split_sql(text: str) -> str:
    marked = f"regexp_replace(regexp_replace({text}, '([.!?;,:|]) +', '\\1' || chr(1), 'g'), '[\\r\\n]+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _like_sql(a: str, b: str) -> str:
    dot = "list_dot_product({0}.lanes, {1}.lanes)"
    size = f"sqrt({dot.format(a, a)} * {dot.format(b, b)})"
    return f"""CASE WHEN {a}.words = {b}.words THEN 1.0::DOUBLE
        ELSE least(greatest(CASE WHEN {size} > 0 THEN {dot.format(a, b)} / {size} ELSE 0.0 END, 0.0), 0.999999::DOUBLE) END"""


#: The same over all documents with different ids, for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), (SELECT text FROM d ORDER BY doc_id DESC LIMIT 1)) AS following FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT DISTINCT t FROM (SELECT text AS t FROM e UNION ALL SELECT edited FROM e)),
h AS (SELECT t, sha256(p) AS h FROM (SELECT t, unnest({_split_sql('t')}) AS p FROM t)),
sums AS (SELECT t, j, sum(CAST('0x' || substr(h, j * 8 + 1, 8) AS BIGINT)) % {MODULUS} AS w FROM h, range({EXACT}) AS r(j) GROUP BY t, j),
moves AS (SELECT t, code % {LANES} AS j, sum(CASE WHEN code < {LANES} THEN 1 ELSE -1 END) AS c
          FROM (SELECT t, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {2 * LANES} AS code FROM h) GROUP BY ALL),
exact AS (SELECT t.t, string_agg(format('{{:08x}}', CAST(coalesce(w, 0) AS BIGINT)), '' ORDER BY r.j) AS words
          FROM t CROSS JOIN range({EXACT}) AS r(j) LEFT JOIN sums ON sums.t = t.t AND sums.j = r.j GROUP BY t.t),
lanes AS (SELECT t.t, list(CAST(coalesce(c, 0) AS DOUBLE) ORDER BY r.j) AS lanes,
                 string_agg(format('{{:04x}}', CAST((coalesce(c, 0) + 65536) % 65536 AS BIGINT)), '' ORDER BY r.j) AS shown
          FROM t CROSS JOIN range({LANES}) AS r(j) LEFT JOIN moves ON moves.t = t.t AND moves.j = r.j GROUP BY t.t),
v AS (SELECT t, words, lanes, words || shown AS shown FROM exact JOIN lanes USING (t))
SELECT doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.shown AS fingerprint,
       b.shown AS edited_fingerprint, {_like_sql('a', 'b')} AS near_edited, {_like_sql('a', 'c')} AS near_next
FROM e JOIN v a ON a.t = e.text JOIN v b ON b.t = e.edited JOIN v c ON c.t = e.following"""


def op4(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (the last half replaced by the start of the next text)."""
    own = docs.select("doc_id", text_of().alias("text")).withColumn("v", vector(F.col("text")))
    rows = with_next(own, "doc_id", ["text", "v"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("ev", vector(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        shown(F.col("v")).alias("fingerprint"),
        shown(F.col("ev")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("ev")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
