"""SQL fragments shared by the checking queries (DuckDB dialect)."""

BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+"


def words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{BLANK}+'), lambda w: w <> '')"


def tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{TOKEN}')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sentences(col: str) -> str:
    """No look-behind in RE2: a marker is put behind each sentence end and split on."""
    marked = rf"regexp_replace({col}, '([.!?]){BLANK}+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def chunks(table: str = "documents", keys: str = "doc_id, source", text: str = "text") -> str:
    """Body of a CTE with one row per kept window."""
    return f"""
    SELECT {keys}, CAST(i AS INTEGER) AS chunk_no, CAST(len(cw) AS INTEGER) AS n_words,
           array_to_string(cw, ' ') AS text
    FROM (SELECT {keys}, i, ws[i * 400 + 1 : i * 400 + 500] AS cw
          FROM (SELECT {keys}, {words(text)} AS ws FROM {table}) d,
               unnest(range(0, CASE WHEN len(ws) <= 500 THEN 1
                                    ELSE CAST(ceil((len(ws) - 500) / 400.0) AS BIGINT) + 1 END)) AS u(i))
    WHERE len(cw) > 20"""


def keyword_scores(chunks_cte: str, queries_cte: str, chunk_cols: str) -> str:
    """Plain every-pair form of the keyword score."""
    return f"""
    SELECT query_id, {chunk_cols},
           CASE WHEN len(hit) = 0 THEN 0.0 ELSE
             least(list_reduce(list_prepend(
               CAST(shared AS DOUBLE) / (len(q) + len(d) - shared),
               list_transform(hit, lambda h: CAST(0.05 AS DOUBLE))), lambda a, b: a + b), 1.0) END AS score
    FROM (SELECT query_id, {chunk_cols}, q, d,
                 list_filter(q, lambda w: contains(low, w)) AS hit,
                 len(list_intersect(q, d)) AS shared
          FROM (SELECT *, list_distinct({tokens('text')}) AS d, lower(text) AS low FROM {chunks_cte}) c,
               (SELECT query_id, list_distinct({tokens('query')}) AS q FROM {queries_cte}) s)"""


def text(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def contains_any(col: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {text(n)})" for n in needles) + ")"


def rules(col: str, table: list[tuple[list[str], str]], default: str) -> str:
    """Ordered substring rules as a CASE expression."""
    whens = " ".join(f"WHEN {contains_any(col, n)} THEN {text(r)}" for n, r in table)
    return f"CASE {whens} ELSE {text(default)} END"
