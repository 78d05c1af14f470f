"""Extractive answers from retrieved chunks and their formatting (ANS-*).

Everything per query happens in one row: a query owns at most five chunks, so the arrays are small and the
whole answer costs no shuffle beyond the one that brought the hits together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import retrieval as R

MIN_SENTENCE = 10
MIN_KEYWORD = 2
MAX_SENTENCES = 4

# Sentences and headers removed from a reply, status labels, default examples, closing lines.
REMOVED_SENTENCES = [
    "I could not find this information in the uploaded knowledge base.",
    "No matching document chunks found.",
]
REMOVED_HEADERS = [r"📚 Source:.*?\n", r"📝 Answer:", r"🌐 General Knowledge Reference:"]
STATUS_MISSING = "❌ Not Found in Knowledge Base"
STATUS_FOUND = "✅ Knowledge Base Answer"
FENCED = r"```(?:python|sql|bash|json)?\n(.*?)\n```"
EXAMPLE_SQL = "```sql\nSELECT * FROM dataset LIMIT 5;\n```"
EXAMPLE_PYTHON = '```python\n# Basic python usage\nprint("Learning Python & Data Science!")\n```'
EXAMPLE_MODEL = (
    "```python\nfrom sklearn.model_selection import train_test_split\n"
    "X_train, X_test, y_train, y_test = train_test_split(X, y, test_size=0.2)\n```"
)
EXAMPLE_OTHER = "```python\n# Explore concepts in Python or SQL\n```"
EXAMPLE_RULES = [
    (["sql"], EXAMPLE_SQL),
    (["python", "pandas", "dropna", "loop"], EXAMPLE_PYTHON),
    (["regression", "classification", "overfitting", "pca", "cross-validation"], EXAMPLE_MODEL),
]
DEFAULT_TAKEAWAY = "Solidify these concepts through coding exercises and practical projects."


def query_keywords(query: Column) -> Column:
    """Distinct lower-cased tokens longer than two characters (ANS-2)."""
    return F.filter(T.distinct_tokens(query), lambda w: F.length(w) > MIN_KEYWORD)


def candidate_sentences(hits: Column) -> Column:
    """Sentences of all hits longer than ten characters, in hit and sentence order (ANS-1)."""

    def of_hit(h: Column) -> Column:
        long_enough = F.filter(T.sentences(h["text"]), lambda s: F.length(s) > MIN_SENTENCE)
        return F.transform(
            long_enough,
            lambda s, i: F.struct(
                h["rank"].alias("rank"), i.alias("pos"), s.alias("sentence"), h["source"].alias("source")
            ),
        )

    return F.flatten(F.transform(hits, of_hit))


def rank_sentences(sentences: Column, keywords: Column) -> Column:
    """Matching sentences, most keywords first, then in reading order (ANS-3, ANS-4)."""

    def scored(s: Column) -> Column:
        return F.struct(
            (-F.size(R.tokens_inside(keywords, s["sentence"]))).alias("order"),
            s["rank"].alias("rank"),
            s["pos"].alias("pos"),
            s["sentence"].alias("sentence"),
            s["source"].alias("source"),
        )

    return F.sort_array(F.filter(F.transform(sentences, scored), lambda s: s["order"] < 0))


def pick_sentences(hits_by_query: DataFrame, query: str = "query", hits: str = "hits") -> DataFrame:
    """Adds ``picked``: up to four distinct best sentences with their source and match count (ANS-4)."""
    ranked = hits_by_query.withColumn("_keywords", query_keywords(F.col(query))).withColumn(
        "_ranked", rank_sentences(candidate_sentences(F.col(hits)), F.col("_keywords"))
    )
    best = ranked.withColumn(
        "_best", F.slice(F.array_distinct(F.transform("_ranked", lambda s: s["sentence"])), 1, MAX_SENTENCES)
    )
    first = F.transform("_best", lambda b: F.filter("_ranked", lambda s: s["sentence"] == b)[0])
    return best.withColumn("picked", first).drop("_keywords", "_ranked", "_best")


def join_by_source(picked: Column) -> Column:
    """Sentences joined by space per source, sources by blank line, both in first-seen order (ANS-5)."""
    order = F.array_distinct(F.transform(picked, lambda s: s["source"]))

    def line(src: Column) -> Column:
        own = F.filter(picked, lambda s: s["source"] == src)
        return F.array_join(F.transform(own, lambda s: s["sentence"]), " ")

    return F.array_join(F.transform(order, line), "\n\n")


def extract_answers(
    queries: DataFrame, hits: DataFrame, query_id: str = "query_id", query: str = "query"
) -> DataFrame:
    """One row per query: ``reply``, ``grounded``, ``sources`` and the hit list (ANS-1…7, RET-9).

    Queries with no hit, or with no matching sentence, get the fixed no-match line.
    """
    gathered = queries.join(R.gather_hits(hits, query_id), query_id, "left")
    found = pick_sentences(gathered, query)
    has_hits = F.coalesce(F.size("hits"), F.lit(0)) > 0
    matched = has_hits & (F.coalesce(F.size("picked"), F.lit(0)) > 0)
    replied = found.withColumn(
        "reply", F.when(matched, join_by_source(F.col("picked"))).otherwise(F.lit(R.NO_ANSWER))
    )
    return replied.withColumn("grounded", grounded(has_hits, F.col("reply"))).withColumn(
        "sources", F.when(has_hits, R.attribution(F.col("hits"))).otherwise(F.lit(""))
    )


def ask(
    chunks: DataFrame, queries: DataFrame, chunk_keys: list[str], k: int | Column = R.CHAT_K,
    query_id: str = "query_id", query: str = "query",
) -> DataFrame:
    """Search, answer and format in one go: one row per query (RET-1…9, ANS-1…14)."""
    scored = R.keyword_matches(chunks, queries, chunk_keys, query_id, query)
    if isinstance(k, Column):
        limits = queries.select(query_id, R.clamp_k(k).alias("_k"))
        ranked = R.top_k(scored, query_id, chunk_keys, R.MAX_K).join(limits, query_id)
        hits = ranked.filter(F.col("rank") <= F.col("_k")).drop("_k")
    else:
        hits = R.top_k(scored, query_id, chunk_keys, k)
    return format_answers(extract_answers(queries, hits, query_id, query), query)


def grounded(has_hits: Column, reply: Column) -> Column:
    """Has hits and does not say it found nothing (ANS-7)."""
    return has_hits & ~F.contains(F.lower(reply), F.lit("could not find the answer"))


def clean_reply(reply: Column) -> Column:
    """Reply without warning sentences and header patterns (ANS-8)."""
    out = reply
    for sentence in REMOVED_SENTENCES:
        out = F.replace(out, F.lit(sentence), F.lit(""))
    for header in REMOVED_HEADERS:
        out = F.regexp_replace(out, f"(?iud){header}", "")
    return T.strip(out)


def format_answers(
    answers: DataFrame,
    query: str = "query",
    reply: str = "reply",
    is_grounded: str = "grounded",
    sources: str = "sources",
) -> DataFrame:
    """Adds ``status``, ``explanation``, ``example``, ``takeaway`` and ``formatted`` (ANS-8…14)."""
    cleaned = answers.withColumn("_clean", clean_reply(F.col(reply)))
    missing = (
        F.contains("_clean", F.lit(R.NO_ANSWER))
        | F.contains("_clean", F.lit("could not find this information"))
        | ~F.col(is_grounded)
    )
    staged = cleaned.withColumn("_missing", missing).withColumn(
        "_block", F.regexp_extract("_clean", f"(?is){FENCED}", 0)
    )
    code = F.regexp_extract("_clean", f"(?is){FENCED}", 1)
    language = F.when(F.contains(F.lower(code), F.lit("select")), "sql").otherwise("python")
    own_example = F.concat(F.lit("```"), language, F.lit("\n"), T.strip(code), F.lit("\n```"))
    default_example = T.first_match(F.lower(F.col(query)), EXAMPLE_RULES, EXAMPLE_OTHER)
    found_status = F.when(
        F.col(sources) != "", F.concat(F.lit(f"{STATUS_FOUND} (Source: "), F.col(sources), F.lit(")"))
    ).otherwise(F.lit(STATUS_FOUND))
    body = F.when(F.col("_block") != "", F.replace(F.col("_clean"), F.col("_block"), F.lit(""))).otherwise(
        F.col("_clean")
    )
    shaped = (
        staged.withColumn("status", F.when(F.col("_missing"), F.lit(STATUS_MISSING)).otherwise(found_status))
        .withColumn(
            "example",
            F.when(F.col("_missing"), F.lit(""))
            .when(F.col("_block") != "", own_example)
            .otherwise(default_example),
        )
        .withColumn(
            "explanation",
            T.strip(
                F.regexp_replace(F.when(F.col("_missing"), F.lit(R.NO_ANSWER)).otherwise(body), r"\n{3,}", "\n\n")
            ),
        )
    )
    last_paragraph = F.try_element_at(T.paragraphs(F.col("explanation"), "\n\n"), F.lit(-1))
    last_sentence = F.try_element_at(T.sentences(last_paragraph), F.lit(-1))
    closed = shaped.withColumn(
        "takeaway", F.coalesce(last_sentence, last_paragraph, F.lit(DEFAULT_TAKEAWAY))
    )
    formatted = F.concat(
        F.lit("📖 Query: "), F.col(query), F.lit("\n"), F.col("status"), F.lit("\n\n📚 Explanation:\n"),
        F.col("explanation"), F.lit("\n\n"),
        F.when(F.col("example") != "", F.concat(F.lit("💻 Example:\n"), F.col("example"), F.lit("\n\n")))
        .otherwise(F.lit("")),
        F.lit("🎯 Key Takeaway:\n"), F.col("takeaway"),
    )
    return closed.withColumn("formatted", formatted).drop("_clean", "_missing", "_block")
