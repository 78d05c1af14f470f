"""Scored retrieval over chunks: keyword, cosine, hybrid, top-k, attribution and prompts (RET-*)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.functions import text as T
from lectern.functions.binding import let, once
from lectern.functions.bounded import as_broadcast, broadcast_if_small
from lectern.functions.joins import left_join_known
from lectern.operators.nearest import nearest, usable, usual_size
from lectern.operators.term_index import ROW, SIZE, TermIndex
from lectern.session import cut, run_dir

# Score threshold, bonus per matching query token, default and largest k, chat k.
THRESHOLD = 0.18
TOKEN_BONUS = 0.05
DEFAULT_K = 3
MAX_K = 5
CHAT_K = 2

# A query batch up to this size travels inside the plan; a larger one goes through the token index.
MAX_BATCH_QUERIES = 256
MAX_BATCH_TOKENS = 1024
ANCHOR = 4
# A key with more rows than this is split over tasks; the sum of all rows bounds the number of such keys.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 50_000
MAX_SALTS = 4096
MAX_BROADCAST_ROWS = 50_000
# Up to this many different query words are looked for in every token; more meet the tokens through anchors.
MAX_SOUGHT_WORDS = 128
# Pairs that pass are a few numbers each; up to this many are broadcast to the chunks.
MAX_CANDIDATES = 500_000


def clamp_k(k: Column) -> Column:
    """Null and 0 mean the default; never above the cap (RET-6)."""
    return F.least(F.coalesce(F.nullif(k, F.lit(0)), F.lit(DEFAULT_K)), F.lit(MAX_K))


def _score(bonus: Column, shared: Column, n_query: Column, n_chunk: Column) -> Column:
    """Jaccard of the distinct tokens plus the bonus, added token by token, at most 1.0."""
    jaccard = shared.cast("double") / (n_query + n_chunk - shared).cast("double")
    folded = F.aggregate(F.sequence(F.lit(1), bonus), jaccard, lambda acc, _: acc + F.lit(TOKEN_BONUS))
    return F.when(bonus > 0, F.least(folded, F.lit(1.0))).otherwise(F.lit(0.0))


def tokens_inside(tokens: Column, text: Column) -> Column:
    """Those tokens that occur anywhere in the lower-cased text."""
    return let(F.lower(text), lambda low: F.filter(tokens, lambda w: F.contains(low, w)))


def keyword_score(query: Column, chunk: Column) -> Column:
    """Score of one query text against one chunk text in the same row (RET-1)."""
    q, d = T.distinct_tokens(query), T.distinct_tokens(chunk)
    bonus = F.size(tokens_inside(q, chunk))
    score = _score(bonus, F.size(F.array_intersect(q, d)), F.size(q), F.size(d))
    return F.when((F.size(q) == 0) | (F.size(d) == 0), F.lit(0.0)).otherwise(score)


def _bounded_batch(queries: DataFrame, query_id: str, text: str) -> list | None:
    """The query batch as rows when its size is proven small, else None."""
    # One token more than the limit is enough to see that a query is too long.
    some = F.slice(T.distinct_tokens(F.coalesce(F.col(text), F.lit(""))), 1, MAX_BATCH_TOKENS + 1)
    rows = (
        queries.select(F.col(query_id).alias("id"), some.alias("tokens"))
        .limit(MAX_BATCH_QUERIES + 1)
        .collect()
    )
    if len(rows) > MAX_BATCH_QUERIES or len({w for r in rows for w in r.tokens}) > MAX_BATCH_TOKENS:
        return None
    return rows


def keyword_matches(
    chunks: DataFrame,
    queries: DataFrame,
    chunk_keys: list[str],
    query_id: str = "query_id",
    query_text: str = "query",
    text: str = "text",
    threshold: float = THRESHOLD,
    use_index: bool | None = None,
) -> DataFrame:
    """All (query, chunk) pairs scoring above the threshold (RET-1, RET-5).

    A batch of proven size is carried in the plan and every chunk is scored where it is read: one pass, no
    shuffle of text or tokens. Beyond that size the pairs come from a token index. Both give the same rows.
    """
    batch = None if use_index else _bounded_batch(queries, query_id, query_text)
    if batch is None:
        return _matches_by_index(chunks, queries, chunk_keys, query_id, query_text, text, threshold)
    return _matches_by_scan(chunks, batch, queries.schema[query_id].dataType, query_id, text, threshold)


def _matches_by_scan(chunks, batch, id_type, query_id, text, threshold) -> DataFrame:
    batch = [r for r in batch if r.tokens]
    if not batch:
        return chunks.select(F.lit(None).cast(id_type).alias(query_id), "*", F.lit(0.0).alias("score")).limit(0)
    vocabulary = sorted({w for r in batch for w in r.tokens})
    all_tokens = F.array(*[F.lit(w) for w in vocabulary])
    asked = F.array(
        *[
            F.struct(F.lit(r.id).cast(id_type).alias("id"), F.array(*[F.lit(w) for w in r.tokens]).alias("tokens"))
            for r in batch
        ]
    )
    none = F.array().cast(t.ArrayType(t.StructType([t.StructField("id", id_type), t.StructField("score", t.DoubleType())])))

    def pairs(inside: Column, tokens: Column) -> Column:
        found = F.struct(
            inside.alias("inside"), F.array_intersect(inside, tokens).alias("exact"), F.size(tokens).alias("n")
        )
        scored = let(
            found,
            lambda c: F.transform(
                asked,
                lambda q: F.struct(
                    q["id"].alias("id"),
                    _score(
                        F.size(F.array_intersect(q["tokens"], c["inside"])),
                        F.size(F.array_intersect(q["tokens"], c["exact"])),
                        F.size(q["tokens"]),
                        c["n"],
                    ).alias("score"),
                ),
            ),
        )
        return F.filter(scored, lambda s: s["score"] > threshold)

    # Only a chunk that holds some query token is tokenised.
    kept = let(
        tokens_inside(all_tokens, F.col(text)),
        lambda inside: F.when(
            F.size(inside) > 0, let(T.distinct_tokens(F.col(text)), lambda tokens: pairs(inside, tokens))
        ).otherwise(none),
    )
    return chunks.select(*[F.col(c) for c in chunks.columns], F.explode(kept).alias("_s")).select(
        F.col("_s.id").alias(query_id), *chunks.columns, F.col("_s.score").alias("score")
    )


def _most_hits(threshold: float) -> int:
    """Hits that always pass the threshold, whatever the sizes."""
    return int(threshold / TOKEN_BONUS + 1e-9) + 1


def _size_limit(threshold: float) -> int | None:
    """Distinct tokens above which a chunk needs ``_most_hits``; None when no size is large enough."""
    b = _most_hits(threshold) - 1
    gap = threshold - b * TOKEN_BONUS
    return int(b / gap) + b + 1 if gap > 1e-6 else None


def _least_hits(n_query: Column, n_chunk: Column, threshold: float) -> Column:
    """Fewest query tokens that must occur in a chunk for the pair to pass the threshold.

    With b occurring tokens at most min(b, chunk tokens) are shared, so the score is at most
    0.05 b + m / (q + c - m). The smallest b whose bound exceeds the threshold is needed.
    """
    top = _most_hits(threshold)
    out = F.lit(top)
    for b in range(top - 1, 0, -1):
        m = F.least(F.lit(b), n_query, n_chunk)
        bound = F.lit(b * TOKEN_BONUS) + m.cast("double") / (n_query + n_chunk - m)
        out = F.when(bound > threshold - 1e-9, F.lit(b)).otherwise(out)
    return out


def _grams(token: Column, width: int) -> Column:
    """All substrings of one width."""
    starts = F.when(F.length(token) >= width, F.sequence(F.lit(1), F.length(token) - width + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.substr(token, i, F.lit(width)))


def _salted_join(
    big: DataFrame, small: DataFrame, key: str, load: DataFrame, spread_by: list[str], hot_rows: int, also: list[str] = ()
) -> DataFrame:
    """Equi-join of a big side with one that is broadcast when proven small.

    Otherwise both sides shuffle, and a key with more than ``hot_rows`` rows on the big side is split over
    salts; only hot keys are repeated on the other side. ``load`` holds ``key, df`` with at least the rows of
    each key.
    """
    few = as_broadcast(small, MAX_BROADCAST_ROWS)
    if few is not None:
        return big.join(few, [key, *also])
    total = load.agg(F.sum("df")).first()[0] or 0
    limit = max(hot_rows, -(-total // MAX_HOT_KEYS))
    hot = load.filter(F.col("df") > limit).select(
        key, F.least(F.ceil(F.col("df") / limit), F.lit(MAX_SALTS)).cast("int").alias("_salts")
    )
    hot = broadcast_if_small(hot, MAX_HOT_KEYS)
    salts = F.coalesce("_salts", F.lit(1))
    repeated = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    split = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
    return split.drop("_salts").hint("merge").join(repeated, [key, "_salt", *also]).drop("_salt")


def _matches_by_index(
    chunks, queries, chunk_keys, query_id, query_text, text, threshold, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Token-index plan for a query table of any size: the chunks are indexed, then searched."""
    spark = chunks.sparkSession
    index = TermIndex(spark, run_dir(spark, "terms"), chunk_keys, text).add(chunks, "all")
    found = index_matches(index, queries, query_id, query_text, threshold, hot_rows)
    return found.select(query_id, *chunks.columns, "score")


def index_matches(
    index: TermIndex, queries: DataFrame, query_id: str = "query_id", query_text: str = "query",
    threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All (query, chunk) pairs scoring above the threshold, from a stored index (RET-1, RET-5); equi-joins only.

    A query token holds word characters only, so it occurs in a text iff it occurs in one of its tokens. A few query
    tokens are looked for in every token where it is read; many meet the vocabulary on an anchor of up to four
    characters. A pair that passes needs ``_least_hits`` occurring tokens, hence one of the query's ``n - least + 1``
    rarest: only those make candidates, which keeps the
    commonest tokens from pairing every chunk with every query. Candidates are then scored exactly from the query words
    that the postings found in each chunk; the chunks themselves are read for the pairs that pass only.
    """
    asked = cut(
        queries.select(F.col(query_id), T.distinct_tokens(F.col(query_text)).alias("_q")).filter(F.size("_q") > 0)
    )
    vocabulary = index.vocabulary()

    words = asked.select(F.explode("_q").alias("word")).distinct()
    sought = [r[0] for r in words.limit(MAX_SOUGHT_WORDS + 1).collect()]
    few_words = len(sought) <= MAX_SOUGHT_WORDS

    def holding(tokens: DataFrame) -> DataFrame:
        """The rows with each of the few words that occur in their token."""
        inside = F.filter(F.array(*[F.lit(w) for w in sought]).cast("array<string>"), lambda w: F.contains("token", w))
        # Most tokens hold none: they are passed over before any array is made.
        return tokens.filter(T.contains_any(F.col("token"), sought)).withColumn("word", F.explode(once(inside)))

    if few_words:
        found = holding(vocabulary)
    else:
        anchored = words.withColumn("anchor", F.substring("word", 1, ANCHOR))
        widths = [r[0] for r in anchored.select(F.length("anchor")).distinct().collect()]  # at most ANCHOR values
        grams = F.flatten(F.array(*[_grams(F.col("token"), g) for g in sorted(widths)]))
        found = (
            vocabulary.select("token", "df", F.explode(F.array_distinct(grams)).alias("anchor"))
            .join(anchored, "anchor")
            .filter(F.contains(F.col("token"), F.col("word")))
        )
    found = cut(found.select("word", "token", "df"))
    weight = found.groupBy("word").agg(F.sum("df").alias("weight"))
    by_rarity = Window.partitionBy(query_id).orderBy("weight", "word")
    # The weight of a word that occurs nowhere is null and sorts first: it stays among the rarest.
    ranked = (
        asked.select(query_id, F.size("_q").alias("_nq"), F.explode("_q").alias("word"))
        .join(weight, "word", "left")
        .withColumn("_rare", F.row_number().over(by_rarity))
        .select(query_id, "_nq", "word", "_rare")
    )
    # One row per chunk that holds query words: those inside some token, and those that are one.
    postings = index.postings()
    if few_words:
        met = holding(postings)
    else:
        met = _salted_join(postings, found.select("token", "word"), "token", vocabulary, ROW, hot_rows)
    hits = cut(
        met.groupBy(*ROW, SIZE)
        .agg(
            F.collect_set("word").alias("_inside"),
            F.collect_set(F.when(F.col("token") == F.col("word"), F.col("word"))).alias("_exact"),
        )
    )
    # Chunks above the size limit need the most hits, so a query's commonest words are not even joined to them.
    top, limit = _most_hits(threshold), _size_limit(threshold)
    sizes = F.when(F.col("_rare") <= F.col("_nq") - top + 1, F.array(F.lit(True), F.lit(False))).otherwise(
        F.array(F.lit(True))
    )
    sized = hits.select(
        *ROW, SIZE, (F.lit(True) if limit is None else F.col(SIZE) <= limit).alias("_small"),
        F.explode(once(F.col("_inside"))).alias("word"),
    )
    load = weight.select("word", F.col("weight").alias("df"))
    candidates = (
        _salted_join(sized, ranked.withColumn("_small", F.explode(sizes)), "word", load, ROW, hot_rows, ["_small"])
        .filter(F.col("_rare") <= F.col("_nq") - _least_hits(F.col("_nq"), F.col(SIZE), threshold) + 1)
        .select(query_id, *ROW)
        .distinct()
    )
    scored = (
        candidates.join(hits, ROW)
        .join(broadcast_if_small(asked), query_id)
        .withColumn(
            "score",
            _score(
                F.size(F.array_intersect("_q", "_inside")), F.size(F.array_intersect("_q", "_exact")), F.size("_q"),
                F.col(SIZE),
            ),
        )
    )
    # Few pairs meet the chunks where these are read, so nothing else moves; many are shuffled with the chunks.
    passed = cut(scored.filter(F.col("score") > threshold).select(query_id, *ROW, "score"))
    few = passed.count() <= MAX_CANDIDATES
    stored = index.chunks()
    columns = [c for c in stored.columns if c not in ROW]
    return stored.join(F.broadcast(passed) if few else passed.hint("merge"), ROW).select(query_id, *columns, "score")


def top_k(
    scored: DataFrame,
    query_id: str,
    order_keys: list[str],
    k: int | Column = CHAT_K,
    score: str = "score",
    rank: str = "rank",
    cap: int = MAX_K,
) -> DataFrame:
    """Best k rows per query, ties by insertion order (RET-4).

    The literal bound lets Spark cut every task to the best rows before the shuffle, so a query that matches
    a third of the store moves only a few rows per task.
    """
    w = Window.partitionBy(query_id).orderBy(F.desc(score), *order_keys)
    bound = k if isinstance(k, int) else cap
    ranked = scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= bound)
    return ranked if isinstance(k, int) else ranked.filter(F.col(rank) <= k)


# ---------------------------------------------------------------------------------------------- vectors


def cosine_matches(
    corpus: DataFrame,
    vec: str,
    queries: DataFrame,
    query_id: str,
    query_vec: str,
    keep: list[str],
    threshold: float | None = THRESHOLD,
    k: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """(query, row) pairs with their cosine score above the threshold (RET-2, RET-5).

    With ``k``, rows that cannot be among a query's best k are left out early; rank the rest with ``top_k``.
    """
    return nearest(corpus, vec, queries, query_id, query_vec, keep, "cosine", k, threshold, digits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns of the same row; NULL when one is NULL, 0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    scale = norm(a) * norm(b)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (scale > 0), dot / scale).when(known, F.lit(0.0))


def hybrid_matches(
    chunks: DataFrame,
    queries: DataFrame,
    chunk_keys: list[str],
    query_id: str = "query_id",
    query_text: str = "query",
    query_vec: str = "query_vec",
    text: str = "text",
    vec: str = "embedding",
    threshold: float = THRESHOLD,
    k: int | None = None,
) -> DataFrame:
    """Cosine where query and chunk have a vector, keyword score where one has none (RET-3). Every pair appears once.

    A vector counts when it has the usual length of the query vectors and only finite numbers. A query without one is
    keyword-scored against every chunk. With ``k``, the best k rows per query come back with their ``rank``; without
    it all pairs above the threshold do, which only a small batch of queries should ask for.
    """
    keep = [c for c in chunks.columns if c != vec]
    size = usual_size(queries, query_vec)
    able = usable(F.col(query_vec), size)
    by_vector = cosine_matches(chunks, vec, queries.filter(able), query_id, query_vec, keep, threshold, k)
    bare = chunks.filter(~usable(F.col(vec), size)).select(*keep)
    parts = [
        by_vector,
        keyword_matches(bare, queries.filter(able), chunk_keys, query_id, query_text, text, threshold),
        keyword_matches(chunks.select(*keep), queries.filter(~able), chunk_keys, query_id, query_text, text, threshold),
    ]
    if k is None:
        return reduce(DataFrame.unionByName, parts)
    # Every part is cut to its best rows before they meet.
    best = [top_k(p, query_id, chunk_keys, k).drop("rank") for p in parts]
    return top_k(reduce(DataFrame.unionByName, best), query_id, chunk_keys, k)


# ------------------------------------------------------------------------------- attribution and prompts

# Context headers, the empty-context line and the instruction of the prompt.
CONTEXT_HEADER = (
    "Use the following retrieved document excerpts as the authoritative source to answer the student's question:\n\n"
)
EMPTY_CONTEXT = "No relevant context found in the database.\n\n"
NO_ANSWER = "I could not find the answer to this question in the uploaded documents."
INSTRUCTION_HEAD = (
    "You are an AI assistant specializing in document Q&A. Your sole task is to answer the user's question "
    "using ONLY the provided retrieved context from the uploaded documents.\n\n"
    "Rules:\n"
    "1. Answer the question directly and concisely, using only facts directly mentioned in the retrieved context.\n"
    "2. Do not include any general knowledge, assumptions, or external information. If the answer cannot be found "
    "in the context, do not attempt to answer it using general knowledge.\n"
    "3. If the retrieved context does not contain the answer to the user's question, you must respond with "
    f"exactly: \"{NO_ANSWER}\"\n"
    "4. Do not summarize the entire document or output overall document details that are not directly relevant to "
    "the specific question asked.\n\n"
    "Response Format:\n"
    "📖 Query: "
)
INSTRUCTION_TAIL = (
    "\n[Insert '✅ Knowledge Base Answer' OR '❌ Not Found in Knowledge Base']\n"
    "📚 Explanation: {detailed explanation}\n"
    "💻 Example: {example code/query}\n"
    "🎯 Key Takeaway: {short summary}"
)


def gather_hits(hits: DataFrame, query_id: str, rank: str = "rank") -> DataFrame:
    """One row per query with its hits in rank order. A group holds at most ``MAX_K`` chunks."""
    return hits.groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), "source", "text"))).alias("hits")
    )


def attribution(hits: Column) -> Column:
    """Distinct sources of a hit list, sorted and joined (RET-9)."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["source"]))), ", ")


def context(hits: Column, numbered: bool = True) -> Column:
    """Context blocks in rank order: the query form is numbered, the chat form is not (RET-10)."""

    def block(h: Column, i: Column) -> Column:
        head = (
            F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), h["source"], F.lit("\n"))
            if numbered
            else F.concat(F.lit("Source ["), h["source"], F.lit("]:\n"))
        )
        return F.concat(head, h["text"], F.lit("\n\n"))

    filled = F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform(hits, block), ""))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, filled).otherwise(F.lit(EMPTY_CONTEXT))


def prompt(query: Column, context_text: Column) -> Column:
    """Instruction, context and question as one string (RET-11)."""
    return F.concat(
        F.lit("System: " + INSTRUCTION_HEAD), query, F.lit(INSTRUCTION_TAIL + "\n\nRetrieved Context:\n"),
        context_text, F.lit("Student Question: "), query, F.lit("\nMentor Answer:"),
    )


def match_source(requests: DataFrame, documents: DataFrame, wanted: str = "course_source") -> DataFrame:
    """Case-insensitive source lookup (RET-12): adds ``matched_source``, ``matched_text`` and ``lookup_error``.

    The first document of a lower-cased name wins. Only names that are asked for are kept before grouping.
    """
    asked = requests.withColumn("_name", F.lower(T.strip(F.col(wanted))))
    named = documents.withColumn("_name", F.lower("source"))
    order = F.col("position") if "position" in documents.columns else F.col("source")
    kept = named.join(asked.select("_name").distinct(), "_name", "left_semi").withColumn("_order", order)
    # The first document of a name is found without texts; only the texts that have its place are read on.
    place = kept.groupBy("_name").agg(F.min(F.struct("_order", "source")).alias("_place"))
    place = place.select(
        F.col("_name").alias("_n"), F.col("_place._order").alias("_o"), F.col("_place.source").alias("_s")
    )
    same = (F.col("_name") == F.col("_n")) & F.col("_order").eqNullSafe(F.col("_o")) & (F.col("source") == F.col("_s"))
    first = (
        kept.join(broadcast_if_small(place), same)
        .groupBy("_name").agg(F.struct(F.first("source").alias("source"), F.max("text").alias("text")).alias("_doc"))
    )
    has_name = F.coalesce(F.col(wanted), F.lit("")) != ""
    return (
        left_join_known(asked, first, "_name")
        .select(
            *requests.columns,
            F.when(has_name, F.col("_doc.source")).alias("matched_source"),
            F.when(has_name, F.col("_doc.text")).alias("matched_text"),
            F.when(
                has_name & F.col("_doc").isNull(),
                F.lit("Selected course source was not found in the knowledge base."),
            ).alias("lookup_error"),
        )
    )
