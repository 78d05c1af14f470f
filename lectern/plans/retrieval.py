"""Queries over documents, chunks and vectors: sources, text work, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.binding import once
from lectern.operators import answering as A
from lectern.operators import chunking as C
from lectern.operators import retrieval as R
from lectern.operators.term_index import TermIndex
from lectern.operators.vector_index import VectorIndex
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table
from lectern.session import run_dir

KEYS = ["doc_id", "source"]

# Search requests of the flagship query: short, as typed by a reader.
SEARCHES = [
    (1, "the of and in", None),
    (2, "der die und ein", 0),
    (3, "le la des une", 2),
    (4, "heat stone red water", 9),
    (5, "tion and heed", 5),
    (6, "python pandas sql", 3),
]
SEARCH_VALUES = ", ".join(
    f"({i}, '{text}', {'NULL' if k is None else k})" for i, text, k in SEARCHES
)
SEARCH_SQL = f"""SELECT * FROM (VALUES {SEARCH_VALUES}) AS s(query_id, query, k)"""


def searches(spark) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, query string, k int")


def documents(spark, sf_dir, *columns) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "source", "text"))))


def _chunks(spark, sf_dir) -> DataFrame:
    return C.chunk_documents(documents(spark, sf_dir), KEYS)


def ranked_searches(spark, sf_dir, k=None) -> DataFrame:
    """Scored, thresholded and ranked chunks of the fixed searches."""
    asked = searches(spark)
    scored = R.keyword_matches(_chunks(spark, sf_dir), asked, ["doc_id", "chunk_no"])
    order = ["doc_id", "chunk_no"]
    if k is not None:
        return R.top_k(scored, "query_id", order, k)
    limits = asked.select("query_id", R.clamp_k(F.col("k")).alias("k"))
    ranked = R.top_k(scored, "query_id", order, R.MAX_K).join(limits, "query_id")
    return ranked.filter(F.col("rank") <= F.col("k"))


RANKED_SQL = f"""
chunks AS ({S.chunks()}),
searches AS ({SEARCH_SQL}),
scored AS ({S.keyword_scores('chunks', 'searches', 'doc_id, source, chunk_no, text')}),
ranked AS (
  SELECT s.*, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id, chunk_no) AS INTEGER) AS rank
  FROM scored s WHERE score > 0.18),
hits AS (
  SELECT r.* FROM ranked r JOIN searches q USING (query_id)
  WHERE rank <= least(coalesce(nullif(q.k, 0), 3), 5))"""


@query("TXT-1", f"SELECT doc_id, source, chunk_no, n_words, text FROM ({S.chunks()})")
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query("RET-7", f"SELECT source, count(*) AS chunks FROM ({S.chunks()}) GROUP BY source")
def source_chunk_counts(spark, sf_dir):
    return C.source_counts(_chunks(spark, sf_dir))


@query("RET-8", f"SELECT count(*) AS total_chunks FROM ({S.chunks()})")
def store_size(spark, sf_dir):
    return C.total_chunks(_chunks(spark, sf_dir))


@query(
    "TXT-2 TXT-3",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct,
               array_to_string(list_sort(list_distinct(t)), ' ') AS vocabulary
        FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""",
)
def document_tokens(spark, sf_dir):
    """Token and distinct-token counts with the sorted vocabulary of every document."""
    toks = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
        F.array_join(F.sort_array(F.array_distinct("t")), " ").alias("vocabulary"),
    )


@query(
    "TXT-4 TXT-5 TXT-6",
    f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, s[pos] AS sentence,
               CAST(len(list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'),
                    lambda p: {S.strip('p')}), lambda p: p <> '')) AS INTEGER) AS n_paragraphs,
               substr({S.strip(f"regexp_replace(text, '{S.BLANK}+', ' ', 'g')")}, 1, 320) AS excerpt
        FROM (SELECT doc_id, text, {S.sentences('text')} AS s FROM documents), unnest(range(1, len(s) + 1)) u(pos)""",
)
def document_sentences(spark, sf_dir):
    """Sentences of every document with paragraph count and excerpt."""
    docs = documents(spark, sf_dir)
    text = F.col("text")
    cut = docs.select(
        "doc_id",
        F.size(T.paragraphs(text)).alias("n_paragraphs"),
        T.excerpt(text).alias("excerpt"),
        T.sentences(text).alias("s"),
    )
    return cut.select("doc_id", "n_paragraphs", "excerpt", F.posexplode(once(F.col("s"))).alias("pos", "sentence"))


@query(
    "RET-1 RET-4 RET-5 RET-6",
    f"WITH {RANKED_SQL} SELECT query_id, doc_id, source, chunk_no, rank, round(score, 6) AS score FROM hits",
)
def keyword_topk(spark, sf_dir):
    hits = ranked_searches(spark, sf_dir)
    return hits.select("query_id", "doc_id", "source", "chunk_no", "rank", F.round("score", 6).alias("score"))


TERM_QUERY_SQL = f"""
words AS (SELECT source, w FROM (SELECT source, unnest({S.tokens('text')}) AS w FROM documents) WHERE length(w) > 3),
counted AS (SELECT source, w, count(*) AS n FROM words GROUP BY ALL),
best AS (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM counted),
searches AS (SELECT source AS query_id, string_agg(w, ' ' ORDER BY r) AS query FROM best WHERE r <= 5 GROUP BY source)"""


_TERM_SQL = f"""WITH {TERM_QUERY_SQL}, chunks AS ({S.chunks()}),
    scored AS ({S.keyword_scores('chunks', 'searches', 'doc_id, chunk_no')}),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no)
               AS INTEGER) AS rank FROM scored WHERE score > 0.18)
    SELECT query_id, doc_id, chunk_no, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5"""


def _term_queries(docs: DataFrame) -> DataFrame:
    counted = (
        docs.select("source", F.explode(T.tokens(F.col("text"))).alias("w"))
        .filter(F.length("w") > 3)
        .groupBy("source", "w")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = R.top_k(counted, "source", ["w"], 5, score="n", rank="r")
    return best.groupBy(F.col("source").alias("query_id")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]), " "
        ).alias("query")
    )


@query("RET-1 RET-4 RET-5 (token index)", _TERM_SQL)
def term_search(spark, sf_dir):
    """Each source's five commonest longer terms searched over the whole store, through the token index."""
    asked = _term_queries(documents(spark, sf_dir))
    scored = R.keyword_matches(_chunks(spark, sf_dir), asked, ["doc_id", "chunk_no"], use_index=True)
    top = R.top_k(scored, "query_id", ["doc_id", "chunk_no"], R.MAX_K)
    return top.select("query_id", "doc_id", "chunk_no", "rank", F.round("score", 6).alias("score"))


@query("RET-1 RET-4 RET-5 SRC-5 (stored index)", _TERM_SQL)
def stored_index_search(spark, sf_dir):
    """The same searches over an index that the documents were appended to in two parts, one of them twice."""
    docs, index = documents(spark, sf_dir), TermIndex(spark, run_dir(spark, "terms"), ["doc_id", "chunk_no"])
    first = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    for name, part in (("a", docs.filter(first)), ("b", docs.filter(~first)), ("a", docs.filter(first))):
        index.add(C.chunk_documents(part, KEYS), name)
    top = R.top_k(R.index_matches(index, _term_queries(docs)), "query_id", ["doc_id", "chunk_no"], R.MAX_K)
    return top.select("query_id", "doc_id", "chunk_no", "rank", F.round("score", 6).alias("score"))


CENTROID_SQL = """
parts AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
          FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY label, i),
centroids AS (SELECT label AS query_id, list(m ORDER BY i) AS query_vec FROM parts GROUP BY label),
scored AS (SELECT query_id, vec_id,
                  list_cosine_similarity(query_vec, CAST(embedding AS DOUBLE[])) AS score
           FROM centroids, embeddings)"""


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label, the query vectors of the cosine queries."""
    parts = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    return parts.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vec")
    )


@query(
    "RET-2 RET-4 RET-5",
    f"""WITH {CENTROID_SQL},
    ranked AS (SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER
               (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank
               FROM scored WHERE score > 0.18)
    SELECT * FROM ranked WHERE rank <= 5""",
)
def cosine_topk(spark, sf_dir):
    """The five vectors nearest to each label's mean vector."""
    vectors = table(spark, sf_dir, "embeddings")
    scored = R.cosine_matches(
        vectors, "embedding", centroids(vectors), "query_id", "query_vec", ["vec_id"], k=R.MAX_K, digits=6
    )
    return R.top_k(scored, "query_id", ["vec_id"], R.MAX_K).select("query_id", "vec_id", "score", "rank")


_INDEX_QUERIES = "SELECT vec_id AS query_id, embedding AS query_vec FROM embeddings WHERE vec_id % 100 = 0"


def _vector_index(spark, sf_dir) -> tuple[VectorIndex, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, run_dir(spark, "vectors"), "vec_id", "embedding").build(vectors)
    asked = vectors.filter("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )
    return index, asked


@query(
    "RET-2 RET-4 (inverted lists)",
    f"""WITH asked AS ({_INDEX_QUERIES}),
    scored AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(query_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score
               FROM asked, embeddings),
    ranked AS (SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER
               (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT * FROM ranked WHERE rank <= 5""",
)
def indexed_vectors(spark, sf_dir):
    """The five vectors nearest to every hundredth one, from the inverted lists that can hold one of them."""
    index, asked = _vector_index(spark, sf_dir)
    return index.search(asked, "query_id", "query_vec", R.MAX_K, digits=6)


@query(
    "RET-2 (inverted lists, recall)",
    f"SELECT count(*) AS n_queries, true AS reached FROM ({_INDEX_QUERIES})",
)
def indexed_recall(spark, sf_dir):
    """Whether the probes set for a recall of 0.95 find nine of ten of the true neighbours of every hundredth vector."""
    index, asked = _vector_index(spark, sf_dir)
    probes = index.probes_for(0.95, R.MAX_K)
    near = index.search(asked, "query_id", "query_vec", R.MAX_K, probes=probes, digits=6)
    true = index.search(asked, "query_id", "query_vec", R.MAX_K, digits=6)
    met = true.join(near.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    share = F.lit(met.count()) >= F.lit(0.9 * true.count())
    return asked.agg(F.count(F.lit(1)).alias("n_queries"), F.any_value(share).alias("reached"))


HYBRID_TEXT = "'vector ' || vec_id || ' of label ' || label || ' group ' || (vec_id % 7)"


@query(
    "RET-3",
    f"""WITH {CENTROID_SQL},
    asked AS (SELECT query_id, query_vec, query_id <> 1 AS able, 'label ' || query_id || ' of group' AS query FROM centroids),
    store AS (SELECT vec_id, {HYBRID_TEXT} AS text, embedding,
                     vec_id % 3 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 17 <> 0 AS able FROM embeddings),
    words AS ({S.keyword_scores('store', 'asked', 'vec_id')}),
    both_kinds AS (
      SELECT query_id, vec_id, list_cosine_similarity(query_vec, CAST(embedding AS DOUBLE[])) AS score
      FROM asked, store WHERE asked.able AND store.able
      UNION ALL SELECT w.query_id, w.vec_id, w.score FROM words w JOIN asked USING (query_id) JOIN store USING (vec_id)
      WHERE NOT (asked.able AND store.able)),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
               FROM both_kinds WHERE score > 0.18)
    SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 200""",
)
def hybrid_search(spark, sf_dir):
    """Cosine for rows with a vector, keyword score for the rest: null, ragged and broken vectors, and a query without."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = centroids(vectors).withColumn("query", F.format_string("label %d of group", "query_id"))
    asked = asked.withColumn("query_vec", F.when(F.col("query_id") != 1, F.col("query_vec")))
    whole, key = F.col("embedding"), F.col("vec_id")
    broken = F.when(key % 3 == 0, F.lit(None)).when(key % 11 == 0, F.slice(whole, 1, 3))
    broken = broken.when(key % 13 == 0, F.transform(whole, lambda x, i: F.when(i != 2, x)))
    broken = broken.when(key % 17 == 0, F.transform(whole, lambda x, i: F.when(i != 1, x).otherwise(F.lit(float("nan")))))
    store = vectors.select("vec_id", F.expr(HYBRID_TEXT).alias("text"), broken.otherwise(whole).alias("embedding"))
    best = R.hybrid_matches(store, asked, ["vec_id"], k=200)
    return best.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


PICKED_SQL = f"""
keywords AS (SELECT query_id, list_filter(list_distinct({S.tokens('query')}), lambda w: length(w) > 2) AS kw
             FROM searches),
split AS (SELECT query_id, rank, source, {S.sentences('text')} AS ss FROM hits),
sent AS (SELECT query_id, rank, source, pos, ss[pos] AS sentence FROM split, unnest(range(1, len(ss) + 1)) u(pos)
         WHERE length(ss[pos]) > 10),
counted AS (SELECT s.*, len(list_filter(k.kw, lambda w: contains(lower(s.sentence), w))) AS n
            FROM sent s JOIN keywords k USING (query_id)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, sentence ORDER BY n DESC, rank, pos) AS dup
           FROM counted WHERE n > 0),
picked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, rank, pos) AS INTEGER) AS place
           FROM firsts WHERE dup = 1),
four AS (SELECT * FROM picked WHERE place <= 4),
by_source AS (SELECT query_id, source, min(place) AS p, string_agg(sentence, ' ' ORDER BY place) AS line
              FROM four GROUP BY query_id, source),
replies AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY p) AS reply FROM by_source GROUP BY query_id),
sourced AS (SELECT query_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM hits GROUP BY query_id),
answers AS (
  SELECT q.query_id, q.query, coalesce(r.reply, '{R.NO_ANSWER}') AS reply, r.reply IS NOT NULL AS grounded,
         coalesce(s.sources, '') AS sources
  FROM searches q LEFT JOIN replies r USING (query_id) LEFT JOIN sourced s USING (query_id))"""


@query(
    "ANS-1 ANS-2 ANS-3 ANS-4",
    f"""WITH {RANKED_SQL}, {PICKED_SQL}
    SELECT query_id, place, sentence, source, CAST(n AS INTEGER) AS n FROM four""",
)
def sentence_answers(spark, sf_dir):
    """The four best distinct sentences per search."""
    hits = ranked_searches(spark, sf_dir)
    gathered = searches(spark).join(R.gather_hits(hits, "query_id"), "query_id")
    picked = A.pick_sentences(gathered).select("query_id", F.posexplode(once(F.col("picked"))).alias("i", "p"))
    return picked.select(
        "query_id",
        (F.col("i") + 1).alias("place"),
        F.col("p.sentence").alias("sentence"),
        F.col("p.source").alias("source"),
        (-F.col("p.order")).alias("n"),
    )


@query(
    "ANS-5 ANS-6 ANS-7 RET-9",
    f"""WITH {RANKED_SQL}, {PICKED_SQL} SELECT query_id, query, reply, grounded, sources FROM answers""",
)
def grounded_answers(spark, sf_dir):
    answers = A.extract_answers(searches(spark), ranked_searches(spark, sf_dir))
    return answers.select("query_id", "query", "reply", "grounded", "sources")


@query(
    "ANS-8 ANS-9 ANS-11 ANS-12 ANS-13 ANS-14",
    f"""WITH {RANKED_SQL}, {PICKED_SQL},
    parts AS (
      SELECT *, CASE WHEN NOT grounded THEN '❌ Not Found in Knowledge Base'
                     ELSE '✅ Knowledge Base Answer (Source: ' || sources || ')' END AS status,
             CASE WHEN NOT grounded THEN ''
                  WHEN contains(query, 'sql') THEN '{A.EXAMPLE_SQL}'
                  WHEN contains(query, 'python') OR contains(query, 'pandas') THEN '{A.EXAMPLE_PYTHON}'
                  ELSE '{A.EXAMPLE_OTHER}' END AS example,
             list_last({S.sentences("list_last(string_split(reply, chr(10) || chr(10)))")}) AS takeaway
      FROM answers)
    SELECT query_id, status, takeaway,
           '📖 Query: ' || query || chr(10) || status || chr(10) || chr(10) || '📚 Explanation:' || chr(10) || reply
           || chr(10) || chr(10)
           || CASE WHEN example <> '' THEN '💻 Example:' || chr(10) || example || chr(10) || chr(10) ELSE '' END
           || '🎯 Key Takeaway:' || chr(10) || takeaway AS formatted
    FROM parts""",
)
def formatted_answers(spark, sf_dir):
    """The whole ask: retrieve, answer, format."""
    answers = A.extract_answers(searches(spark), ranked_searches(spark, sf_dir))
    return A.format_answers(answers).select("query_id", "status", "takeaway", "formatted")


CHAT_SQL = RANKED_SQL.replace("WHERE rank <= least(coalesce(nullif(q.k, 0), 3), 5)", "WHERE rank <= 2")


@query(
    "RET-6 ANS-5 ANS-7 (chat form)",
    f"""WITH {CHAT_SQL}, {PICKED_SQL} SELECT query_id, reply, grounded, sources FROM answers""",
)
def chat_answers(spark, sf_dir):
    """The chat form of the ask: always two chunks."""
    answers = A.ask(_chunks(spark, sf_dir), searches(spark), ["doc_id", "chunk_no"])
    return answers.select("query_id", "reply", "grounded", "sources")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "RET-10 RET-11",
    f"""WITH {RANKED_SQL},
    blocks AS (SELECT query_id,
        string_agg('[' || rank || '] Source: ' || source || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS a,
        string_agg('Source [' || source || ']:' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS b
      FROM hits GROUP BY query_id),
    ctx AS (SELECT query_id, query,
        coalesce({_sql_text(R.CONTEXT_HEADER)} || a, {_sql_text(R.EMPTY_CONTEXT)}) AS context,
        coalesce({_sql_text(R.CONTEXT_HEADER)} || b, {_sql_text(R.EMPTY_CONTEXT)}) AS chat_context
      FROM searches LEFT JOIN blocks USING (query_id))
    SELECT query_id, chat_context, 'System: ' || {_sql_text(R.INSTRUCTION_HEAD)} || query
        || {_sql_text(R.INSTRUCTION_TAIL)} || chr(10) || chr(10) || 'Retrieved Context:' || chr(10) || context
        || 'Student Question: ' || query || chr(10) || 'Mentor Answer:' AS prompt
    FROM ctx""",
)
def search_prompts(spark, sf_dir):
    """Context blocks in both forms and the full prompt per search."""
    hits = R.gather_hits(ranked_searches(spark, sf_dir), "query_id")
    asked = searches(spark).join(hits, "query_id", "left")
    return asked.select(
        "query_id",
        R.context(F.col("hits"), numbered=False).alias("chat_context"),
        R.prompt(F.col("query"), R.context(F.col("hits"))).alias("prompt"),
    )


REPLY_SQL = """
replies AS (
  SELECT event_id, event_type AS query,
    CASE event_id % 6
      WHEN 0 THEN '📝 Answer: Value ' || event_id || ' is known.' || chr(10) || '```sql' || chr(10) || 'SELECT '
                  || event_id || chr(10) || '```' || chr(10) || chr(10) || chr(10) || chr(10) || 'Done! Keep it.'
      WHEN 1 THEN '📚 source: list ' || event_id || chr(10) || '```' || chr(10) || 'x = ' || event_id || chr(10) || '```'
      WHEN 2 THEN 'No matching document chunks found.'
      WHEN 3 THEN 'I could not find this information in the uploaded knowledge base.Plain ' || event_type || '. Yes? No'
      WHEN 4 THEN '🌐 general knowledge reference: one' || chr(10) || chr(10) || 'two ' || event_type || '. three'
      ELSE 'We could not find this information on ' || event_id END AS reply,
    event_id % 7 <> 0 AS grounded,
    CASE WHEN event_id % 2 = 0 THEN 'guide_' || user_id || '.txt' ELSE '' END AS sources
  FROM events)"""


@query(
    "ANS-8 ANS-9 ANS-10 ANS-12 ANS-13",
    f"""WITH {REPLY_SQL},
    shaped AS (
      SELECT event_id, sources, NOT grounded OR event_id % 6 = 5 AS missing,
        CASE event_id % 6
          WHEN 0 THEN 'Value ' || event_id || ' is known.' || chr(10) || chr(10) || 'Done! Keep it.'
          WHEN 1 THEN '' WHEN 2 THEN ''
          WHEN 3 THEN 'Plain ' || query || '. Yes? No'
          WHEN 4 THEN 'one' || chr(10) || chr(10) || 'two ' || query || '. three' END AS body,
        CASE event_id % 6
          WHEN 0 THEN '```sql' || chr(10) || 'SELECT ' || event_id || chr(10) || '```'
          WHEN 1 THEN '```python' || chr(10) || 'x = ' || event_id || chr(10) || '```'
          ELSE '{A.EXAMPLE_OTHER}' END AS example,
        CASE event_id % 6 WHEN 0 THEN 'Keep it.' WHEN 3 THEN 'No' WHEN 4 THEN 'three'
          ELSE '{A.DEFAULT_TAKEAWAY}' END AS last
      FROM replies)
    SELECT event_id,
      CASE WHEN missing THEN '❌ Not Found in Knowledge Base' WHEN sources = '' THEN '✅ Knowledge Base Answer'
           ELSE '✅ Knowledge Base Answer (Source: ' || sources || ')' END AS status,
      CASE WHEN missing THEN '{R.NO_ANSWER}' ELSE body END AS explanation,
      CASE WHEN missing THEN '' ELSE example END AS example,
      CASE WHEN missing THEN '{R.NO_ANSWER}' ELSE last END AS takeaway
    FROM shaped""",
)
def reply_formatting(spark, sf_dir):
    """Raw replies of six shapes, one per event, cleaned and formatted; the SQL states each shape's result."""
    table(spark, sf_dir, "events").createOrReplaceTempView("lectern_events")
    sql = REPLY_SQL.replace("FROM events", "FROM lectern_events")
    raw = spark.sql(f"WITH {sql} SELECT * FROM replies")
    return A.format_answers(raw).select("event_id", "status", "explanation", "example", "takeaway")


@query(
    "RET-12",
    """WITH named AS (SELECT lower(source) AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    asked AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '  SRC' || (l_suppkey % 30) || ' ' AS wanted
              FROM lineitem)
    SELECT wanted, d.source AS matched_source, d.n_chars AS matched_chars,
           CASE WHEN d.doc_id IS NULL THEN 'Selected course source was not found in the knowledge base.' END
             AS lookup_error, count(*) AS requests
    FROM asked LEFT JOIN named n ON n.name = lower(trim(wanted)) LEFT JOIN documents d ON d.doc_id = n.doc_id
    GROUP BY ALL""",
)
def source_lookup(spark, sf_dir):
    """Each line item asks for a source by a differently cased name; unknown names give an error row."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("  SRC"), (F.col("l_suppkey") % 30).cast("string"), F.lit(" ")).alias("wanted")
    )
    requests = asked.groupBy("wanted").agg(F.count(F.lit(1)).alias("requests"))
    docs = table(spark, sf_dir, "documents").withColumn("position", F.col("doc_id"))
    found = R.match_source(requests, docs, "wanted")
    return found.select(
        "wanted",
        "matched_source",
        F.length("matched_text").cast("bigint").alias("matched_chars"),
        "lookup_error",
        "requests",
    )
