import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import answering as A
from lectern.operators import chunking as C
from lectern.operators import nearest as N
from lectern.operators import retrieval as R
from lectern.plans import sql as S

# Sample texts whose scores are known.
PANDAS = (
    "Pandas introduces two main data structures: Series and DataFrame. DataFrames represent tabular spreadsheets. "
    "They are widely used for data manipulation and exploratory data analysis in python projects."
)
FIT = (
    "Overfitting is when a model fits the training data too closely. We can prevent overfitting by using "
    "regularization techniques. This is a very important concept in machine learning and data science."
)


def ask(spark, texts, queries, k=3):
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "pos int, source string, text string")
    chunks = C.chunk_documents(docs, ["pos", "source"])
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id int, query string")
    hits = R.top_k(R.keyword_matches(chunks, asked, ["pos", "chunk_no"]), "query_id", ["pos", "chunk_no"], k)
    return A.format_answers(A.extract_answers(asked, hits)).orderBy("query_id").collect()


@pytest.mark.parametrize(
    "query,text,score",
    [("What is a DataFrame?", PANDAS, 1 / 27 + 0.15), ("Explain overfitting and regularization", FIT, 0.257142857)],
)
def test_keyword_golden(spark, query, text, score):
    frame = spark.createDataFrame([(query, text)], "q string, t string")
    assert frame.select(R.keyword_score(F.col("q"), F.col("t"))).first()[0] == pytest.approx(score, abs=1e-6)


def test_keyword_score_without_tokens(spark):
    frame = spark.createDataFrame([("", "x"), ("x", "..."), ("", ""), ("x", "x")], "q string, t string")
    assert [r[0] for r in frame.select(R.keyword_score(F.col("q"), F.col("t"))).collect()] == [0.0, 0.0, 0.0, 1.0]


def every_pair(chunks, asked):
    """(query, document, chunk) -> score above the threshold by the every-pair SQL."""
    con = duckdb.connect()
    con.register("chunk_rows", chunks.select("doc_id", "chunk_no", "text").toPandas())
    con.register("asked", asked.toPandas())
    rows = con.execute(
        f"SELECT * FROM ({S.keyword_scores('chunk_rows', 'asked', 'doc_id, chunk_no')}) WHERE score > 0.18"
    ).fetchall()
    return {(r[0], None if r[1] != r[1] else r[1], None if r[2] != r[2] else r[2]): r[3] for r in rows}


def test_scan_index_and_brute_force_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = C.chunk_documents(docs, ["doc_id", "source"]).cache()
    texts = ["the of and in", "tion heed", "le la des un", "a e i o u", "zzzq the", "", "...", "der die das und ein von", "red"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    keys = ["doc_id", "chunk_no"]
    want = every_pair(chunks, asked)
    cols = ["query_id", *keys, "score"]
    scan = R.keyword_matches(chunks, asked, keys, use_index=False).select(cols).collect()
    index = R.keyword_matches(chunks, asked, keys, use_index=True).select(cols).collect()
    for got in (scan, index):
        assert {tuple(r)[:3] for r in got} == set(want) and len(got) == len(want)
        for r in got:
            assert r["score"] == pytest.approx(want[tuple(r)[:3]], abs=1e-12)


def test_null_keys_and_repeated_chunks_give_the_same_rows_in_both_plans(spark, monkeypatch):
    rows = [(1, 0, "red ring of steel"), (None, 0, "red ring"), (None, None, "red"), (2, None, "blue red"), (3, 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk_no int, text string")
    asked = spark.createDataFrame([(1, "red ring"), (None, "blue"), (3, None)], "query_id int, query string")
    asked = asked.filter("query_id is not null")
    keys = ["doc_id", "chunk_no"]
    for limit in (R.MAX_CANDIDATES, 0):
        monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", min(limit, R.MAX_BROADCAST_ROWS))
        monkeypatch.setattr(R, "MAX_CANDIDATES", limit)
        got = [
            sorted(map(str, R.keyword_matches(chunks, asked, keys, use_index=i).select("query_id", *keys, "score").collect()))
            for i in (False, True)
        ]
        assert got[0] == got[1] and len(got[0]) == 4


def test_broken_vectors_fall_back_to_words(spark):
    nan = float("nan")
    rows = [(1, "red ring", [1.0, 0.0]), (2, "red ring", [1.0]), (3, "red ring", [None, 1.0]), (4, "red ring", [nan, 1.0]),
            (5, "red ring", None), (6, "blue", [1.0, 0.0, 2.0])]
    store = spark.createDataFrame(rows, "id int, text string, embedding array<float>")
    asked = spark.createDataFrame(
        [(1, "red ring", [2.0, 0.0]), (2, "red ring", None), (3, "blue", [1.0]), (4, "x", [0.0, 1.0])],
        "query_id int, query string, query_vec array<float>",
    )
    got = {(r["query_id"], r["id"]): r["score"] for r in R.hybrid_matches(store, asked, ["id"]).collect()}
    assert got == {(1, i): 1.0 for i in range(1, 6)} | {(2, i): 1.0 for i in range(1, 6)} | {(3, 6): 1.0}
    best = R.hybrid_matches(store, asked, ["id"], k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in best) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 6)]


def test_index_with_hot_tokens_and_shuffles(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = C.chunk_documents(docs, ["doc_id", "source"])
    asked = spark.createDataFrame([(1, "the of and in"), (2, "heed tion the by"), (3, "red ring")], "query_id int, query string")
    keys = ["doc_id", "chunk_no"]
    want = sorted(map(tuple, R.keyword_matches(chunks, asked, keys, use_index=False).select("query_id", *keys, "score").collect()))
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(R, "MAX_CANDIDATES", 0)
    args = (chunks, asked, keys, "query_id", "query", "text", 0.18)
    got = R._matches_by_index(*args, hot_rows=20).select("query_id", *keys, "score")
    assert sorted(map(tuple, got.collect())) == want


def test_results_do_not_depend_on_partitioning(spark, sf):
    from lectern.plans.retrieval import searches

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    results = []
    for n in (1, 16):
        chunks = C.chunk_documents(docs.repartition(n), ["doc_id", "source"])
        scored = R.keyword_matches(chunks, searches(spark), ["doc_id", "chunk_no"])
        top = R.top_k(scored, "query_id", ["doc_id", "chunk_no"], 3)
        results.append(sorted(tuple(r) for r in top.select("query_id", "doc_id", "chunk_no", "rank", "score").collect()))
    assert results[0] == results[1]


def test_one_text_holding_a_third_of_all_rows(spark):
    rows = [(i, "s", " ".join(["alpha beta gamma delta"] * 8)) for i in range(300)]
    rows += [(300 + i, "s", " ".join(f"w{i}x{j}" for j in range(30))) for i in range(600)]
    chunks = C.chunk_documents(spark.createDataFrame(rows, "doc_id int, source string, text string"), ["doc_id", "source"])
    asked = spark.createDataFrame([(1, "alpha beta gamma delta")], "query_id int, query string")
    for index in (False, True):
        pairs = R.keyword_matches(chunks, asked, ["doc_id", "chunk_no"], use_index=index)
        assert pairs.count() == 300
        best = R.top_k(pairs, "query_id", ["doc_id", "chunk_no"], 3).orderBy("rank").collect()
        assert [r["doc_id"] for r in best] == [0, 1, 2]


def test_clamp(spark):
    frame = spark.createDataFrame([(None,), (0,), (2,), (9,)], "k int")
    assert [r[0] for r in frame.select(R.clamp_k(F.col("k"))).collect()] == [3, 3, 2, 5]


def test_ask_grounded_and_missing(spark):
    got = ask(spark, [("overfitting_guide.txt", FIT), ("pandas_guide.txt", PANDAS)],
              ["Explain overfitting and regularization", "What is a DataFrame?", "qqq www"])
    assert "Overfitting is when a model fits the training data too closely" in got[0]["formatted"]
    assert "regularization techniques" in got[0]["formatted"] and got[0]["grounded"]
    assert got[0]["status"] == "✅ Knowledge Base Answer (Source: overfitting_guide.txt)"
    assert "DataFrames represent tabular spreadsheets" in got[1]["reply"] and got[1]["grounded"]
    assert got[2]["reply"] == R.NO_ANSWER and not got[2]["grounded"] and got[2]["example"] == ""
    assert "❌ Not Found" in got[2]["formatted"]


def test_empty_store(spark):
    got = ask(spark, [("short", "too few words")], ["What is overfitting?"])
    assert got[0]["reply"] == R.NO_ANSWER and got[0]["grounded"] is False


def test_cosine_and_fallback(spark):
    rows = [(1, "s", "same words here", [1.0, 0.0]), (2, "s", "x", [-1.0, 0.0]), (3, "s", "y", [0.0, 0.0]),
            (4, "s", "same words here too", None)]
    store = spark.createDataFrame(rows, "chunk_id int, source string, text string, embedding array<float>")
    asked = spark.createDataFrame([(7, "same words here too", [2.0, 0.0])], "query_id int, query string, query_vec array<float>")
    scored = R.cosine_matches(store, "embedding", asked, "query_id", "query_vec", ["chunk_id"], None)
    assert {r["chunk_id"]: r["score"] for r in scored.collect()} == {1: 1.0, 2: -1.0, 3: 0.0}
    both = {r["chunk_id"]: r["score"] for r in R.hybrid_matches(store, asked, ["chunk_id"]).collect()}
    assert both == {1: 1.0, 4: 1.0}
    same = store.select("chunk_id", R.cosine(F.col("embedding"), F.array(F.lit(2.0), F.lit(0.0))).alias("c")).collect()
    assert {r["chunk_id"]: r["c"] for r in same if r["c"] is not None} == {1: 1.0, 2: -1.0, 3: 0.0}


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 6 * 4])
def test_nearest_with_copies(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(N, "MAX_BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6)).round(2)
    vectors[30:60] = vectors[30]  # a third of the rows are copies
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, v array<double>").repartition(5)
    asked = corpus.filter("id % 9 = 3").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = N.nearest(corpus, "v", asked, "q", "qv", ["id"], "euclidean", k=4, digits=9)
    top = R.top_k(found, "q", ["id"], 4, cap=4).collect()
    got = {}
    for r in top:
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q in range(3, 90, 9):
        dist = np.round(np.linalg.norm(vectors - vectors[q], axis=1), 9)
        want = sorted(range(90), key=lambda i: (dist[i], i))[:4]
        assert [i for _, i in sorted(got[q])] == want


def test_cells_compare_fewer_pairs_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 4)) * 50
    rows = np.concatenate([c + rng.normal(size=(60, 4)) for c in centres])
    rows[:300] = rows[0]
    pivots = rows[rng.choice(len(rows), 64, replace=False)]
    d = N._pivot_distances(rows, pivots)
    cell = d.argmin(axis=1)
    counts = np.bincount(cell, minlength=64)
    radii = np.array([d[cell == c, c].max() if counts[c] else 0.0 for c in range(64)])
    asked = rows[::7]
    reach = N.reachable_cells(N._pivot_distances(asked, pivots), radii, counts, 5)
    compared = (reach * counts).sum()
    assert compared < 0.4 * len(asked) * len(rows)
    for q, cells in zip(asked, reach):
        nearest = np.sort(np.linalg.norm(rows - q, axis=1))[:5]
        left = np.sort(np.linalg.norm(rows[cells[cell]] - q, axis=1))[:5]
        assert np.allclose(nearest, left)


def test_a_block_gives_up_at_most_k_rows_per_query(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for width in (3, 20):
        rows, asked = rng.normal(size=(5000, width)).round(1), rng.normal(size=(40, width)).round(1)
        keys = rng.permutation(5000)
        batch = pa.record_batch({"id": pa.array(keys), "_vec": pa.array(list(rows))})
        queries = pa.table({"_query": pa.array(np.arange(40)), "_asked": pa.array(list(asked))})
        out = pa.Table.from_batches(list(N._scorer("q", ["id"], "euclidean", 5, None, 6)(batch, queries)))
        assert out.num_rows == 40 * 5
        got = {}
        for r in out.to_pylist():
            got.setdefault(r["q"], set()).add(r["id"])
        for q in range(40):
            d = np.round(np.linalg.norm(rows - asked[q], axis=1), 6)
            assert got[q] == {keys[i] for i in sorted(range(5000), key=lambda i: (d[i], keys[i]))[:5]}


@pytest.mark.parametrize("width,others", [(2, False), (2, True), (18, True)])
def test_cells_find_what_every_pair_finds(spark, monkeypatch, width, others):
    """Cells of a few rows, copies, repeated keys: the neighbours of a plain loop over all pairs."""
    monkeypatch.setattr(N, "MAX_SCAN_PAIRS", 0)
    monkeypatch.setattr(N, "CELL_ROWS", 30)
    monkeypatch.setattr(N, "SHARE_ROWS", 50)
    rng = np.random.default_rng(width)
    vectors = rng.normal(size=(200, width)).round(1)
    vectors[40:90] = vectors[40]
    keys = [int(k) for k in rng.permutation(200)]
    keys[41:47] = [keys[40]] * 6
    rows = [(k, [float(x) for x in v]) for k, v in zip(keys, vectors)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = corpus.dropDuplicates(["id"]).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = N.nearest(corpus, "v", asked, "q", "qv", ["id"], "euclidean", k=4, digits=6, others=others)
    got = {}
    for r in R.top_k(found, "q", ["id"], 4, cap=4).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    own = {r["q"]: np.array(r["qv"]) for r in asked.collect()}
    for q, v in own.items():
        d = np.round(np.linalg.norm(vectors - v, axis=1), 6)
        want = sorted((d[i], keys[i]) for i in range(200) if not others or keys[i] != q)[:4]
        assert [(-s, i) for _, i, s in sorted(got[q])] == want


def test_source_lookup(spark):
    docs = spark.createDataFrame([("Guide.TXT", "a", 1), ("guide.txt", "b", 2), ("c", "c", 3)], "source string, text string, position int")
    asked = spark.createDataFrame([(1, " GUIDE.txt "), (2, "none"), (3, None), (4, "")], "id int, course_source string")
    got = {r["id"]: r for r in R.match_source(asked, docs).collect()}
    assert got[1]["matched_text"] == "a" and got[1]["lookup_error"] is None
    assert got[2]["lookup_error"] and got[2]["matched_source"] is None
    assert got[3]["lookup_error"] is None and got[4]["lookup_error"] is None


def test_formatting_cases(spark):
    long = "Intro.\n```SQL\nselect 1\n```\nEnd one. End two."
    rows = [("q", long, True, ""), ("a loop", "Just text", True, "x.txt"), ("pca", "```\nx=1\n```", True, "")]
    frame = spark.createDataFrame(rows, "query string, reply string, grounded boolean, sources string")
    got = A.format_answers(frame).collect()
    assert got[0]["example"] == "```sql\nselect 1\n```" and got[0]["takeaway"] == "End two."
    assert got[0]["explanation"] == "Intro.\n\nEnd one. End two."
    assert got[1]["example"] == A.EXAMPLE_PYTHON and got[1]["status"].endswith("(Source: x.txt)")
    assert got[2]["explanation"] == "" and got[2]["takeaway"] == A.DEFAULT_TAKEAWAY
