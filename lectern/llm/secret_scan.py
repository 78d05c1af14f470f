"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Everything is a column expression on the row: no shuffle, no Python worker. The entropy of a window of ``window``
characters is ``log2(window) - S / window`` with ``S`` the sum of ``c * log2(c)`` over its character counts. ``S`` is
kept by incremental counts: each step takes the leaving character's count down and the entering one's up. A candidate
is reported when its best window reaches the threshold of its class and no allow-list pattern holds for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.llm import spans
from lectern.llm.common import text_of

ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
# A run shorter than the least length is never a hit, and no start inside it can be one.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
BASE_KINDS = ["assign", "access", "hex"]

#: Character classes: strings to look at, the least entropy in bits of their best window, and what belongs to a
#: narrower class. Each string is judged in the narrowest class that holds it.
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 2.9, None),
    "entropy_alnum": (r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}", 3.7, "^[0-9A-Fa-f]+$"),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", 3.9, "^[0-9A-Za-z]+$"),
}
KINDS = BASE_KINDS + list(CLASSES)

#: Strings that look random but are known to be harmless.
ALLOW = (
    r"^[0-9]+$",
    r"^[^0-9]+$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|123456789a|abcdefghij",
)
WINDOW = 20


def best_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any window of the string; null when it is shorter than the window."""
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def count(text, char):
        return F.char_length(text) - F.char_length(F.replace(text, char, F.lit("")))

    def step(acc, char):
        full = F.char_length(acc["win"]) >= window
        gone = count(acc["win"], F.left(acc["win"], F.lit(1)))
        kept = F.when(full, F.substr(acc["win"], F.lit(2))).otherwise(acc["win"])
        less = F.when(full, F.get(cost, gone) - F.get(cost, gone - 1)).otherwise(0.0)

        def entered(kept):
            there = count(kept, char)
            total = acc["total"] - less + F.get(cost, there + 1) - F.get(cost, there)
            return F.struct(
                F.concat(kept, char).alias("win"),
                total.alias("total"),
                F.when(F.char_length(kept) + 1 >= window, F.least(acc["least"], total))
                .otherwise(acc["least"])
                .alias("least"),
            )

        return let(kept, entered)

    start = F.struct(F.lit("").alias("win"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.when(
        F.char_length(value) >= window,
        F.aggregate(chars, start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window),
    )


def _base(text: Column) -> Column:
    """The fixed patterns; a match that fails its rule is dropped and not tried again."""

    def of(kind, pattern, keep):
        return F.transform(
            F.filter(spans.matches(text, pattern), keep),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["hit"].alias("value"),
                F.lit(None).cast("double").alias("entropy"),
            ),
        )

    return F.concat(
        of("assign", ASSIGN, lambda m: F.char_length(F.regexp_replace(m["hit"], "^" + ASSIGN_HEAD, "")) >= 8),
        of("access", ACCESS, lambda m: F.char_length(m["hit"]) >= 16),
        of("hex", HEX, lambda m: F.char_length(m["hit"]) >= 32),
    )


def _by_entropy(text: Column, base: Column, window: int, allow: tuple[str, ...]) -> Column:
    """Candidate strings of every class that pass the threshold and touch no fixed-pattern span."""

    def of(kind, pattern, least, narrower):
        def scored(m):
            return F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["hit"].alias("value"),
                best_entropy(m["hit"], window).alias("entropy"),
            )

        def wanted(m):
            known = m["hit"].rlike(narrower) if narrower else F.lit(False)
            for rule in allow:
                known = known | m["hit"].rlike(rule)
            return ~spans.overlaps(m, base) & ~known

        # `scored` runs once per candidate; the filter reads its result.
        candidates = F.filter(spans.matches(text, pattern), wanted)
        return let(F.transform(candidates, scored), lambda rows: F.filter(rows, lambda s: s["entropy"] >= least))

    return F.concat(*[of(kind, *rule) for kind, rule in CLASSES.items()])


def find_secrets(
    docs: DataFrame, text: str = "text", out: str = "secrets", window: int = WINDOW, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """The rows with ``out``: array<struct<kind, start, stop, value, entropy>>, fixed patterns first.

    Offsets count code points, ends exclusive. A null or empty text has no secrets. Rows are neither joined nor
    grouped, so repeated rows and null keys stay as they are; a column that is already named ``out`` is replaced. A
    string without a blank may be of any length: the cost grows with its length.
    """
    body = text_of(text)
    found = let(body, lambda t: let(_base(t), lambda base: F.concat(base, _by_entropy(t, base, window, allow))))
    return docs.withColumn(out, found)


def digest_columns(found: Column) -> dict[str, Column]:
    """Counts and digests of the spans, as the query returns them."""
    base = F.filter(found, lambda s: s["kind"].isin(BASE_KINDS))
    return {f"n_{kind}": spans.count_of(base, kind) for kind in BASE_KINDS} | {
        "base_sha256": F.sha2(spans.digest(base, KINDS), 256),
        "spans": spans.digest(found, KINDS),
    }


def _sql() -> str:
    """The same over all documents with different ids, for DuckDB, whose patterns know no look-behind.

    A pattern that takes a whole run of characters needs none; a base64 string must not follow an equals sign.
    """

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def either(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    head = "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ASSIGN_HEAD[ASSIGN_HEAD.index(")") :]
    head = head.replace("\\x20", " ")

    def found(kind: str, pattern: str, keep: str) -> str:
        sizes = "list_sum(list_transform({}[1:i], lambda x: length(x)))"
        return f"""SELECT doc_id, t, {quoted(kind)} AS kind, {KINDS.index(kind)} AS n, stop - length(hit) AS start, stop, hit FROM (
          SELECT doc_id, t, hits[i] AS hit, CAST({sizes.format('gaps')} + {sizes.format('hits')} AS BIGINT) AS stop FROM (
            SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
              SELECT doc_id, t, regexp_extract_all(t, {quoted(pattern)}) AS hits, string_split_regex(t, {quoted(pattern)}) AS gaps FROM d)))
          WHERE {keep}"""

    rules = {
        "assign": (head + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(hit, {quoted('^' + head)}, '')) >= 8"),
        "access": (ACCESS, "length(hit) >= 16"),
        "hex": ("[0-9a-f]+", "length(hit) >= 32"),
    }
    base = " UNION ALL ".join(found(kind, *rule) for kind, rule in rules.items())
    known = " OR ".join(f"regexp_matches(hit, {quoted(rule)})" for rule in ALLOW)
    parts = []
    for kind, (pattern, least, narrower) in CLASSES.items():
        keep = f"NOT ({known}) AND entropy(hit) >= {least}"
        if narrower:
            keep += f" AND NOT regexp_matches(hit, {quoted(narrower)})"
        if kind == "entropy_base64":
            keep += " AND (stop = length(hit) OR substr(t, stop - length(hit), 1) <> '=')"
        parts.append(found(kind, pattern[pattern.index(")") + 1 :], keep))
    cost = "list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) * log2(len(list_filter(c, lambda y: y = x)))))"
    for i, part in enumerate(parts):  # the entropy of the best window
        windows = f"list_transform(range(1, length(hit) - {WINDOW} + 2), lambda j: string_split(substr(hit, j, {WINDOW}), ''))"
        best = f"log2({WINDOW}) - list_min(list_transform({windows}, lambda c: {cost})) / {WINDOW}"
        parts[i] = part.replace("entropy(hit)", f"({best})")
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n, stop)"
    counts = ", ".join(f"count(*) FILTER (kind = {quoted(k)}) AS n_{k}" for k in BASE_KINDS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({base}),
    others AS ({" UNION ALL ".join(parts)}),
    added AS (SELECT * FROM others o WHERE NOT EXISTS (
        SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
    everything AS (SELECT * FROM base UNION ALL SELECT * FROM added)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)},
           sha256(coalesce(of_base, '')) AS base_sha256, coalesce(of_all, '') AS spans
    FROM d LEFT JOIN (SELECT doc_id, {counts}, {shown} AS of_base FROM base GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, {shown} AS of_all FROM everything GROUP BY doc_id) USING (doc_id)"""


SQL = _sql()


def op10(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(name) for name, c in digest_columns(F.col("secrets")).items()])
