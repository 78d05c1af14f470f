import pytest
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.operators import assessment as A


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_topics_and_banks(spark):
    rows = [("Python workflow",), ("Pandas",), ("NLP basics",), ("HTML",), ("cooking",)]
    got = values(spark, rows, "t string", A.topic_key(F.col("t")), A.bank_key(F.col("t")))
    assert got == [("python", "workflows"), ("pandas", "pandas"), ("nlp", "nlp"), ("machine learning", "machine learning"), ("machine learning", "general")]


def test_projects(spark):
    rows = [("unsupervised",), ("Supervised",), ("EDA supervised",), ("computer vision",), ("else",)]
    got = values(spark, rows, "t string", A.project_key(F.col("t")))
    assert [g[0] for g in got] == ["unsupervised", "supervised", "exploration", "vision", "general"]
    assert [g[0] for g in values(spark, [("Beginner",), ("x",)], "d string", A.difficulty_key(F.col("d")))] == ["beginner", "intermediate"]


def test_item_filter(spark):
    rows = [("Python", "about a Tuple", None, ["x"]), ("Python", "about rows", "none", ["A DICT"]), ("SQL", "about rows", "x", ["y"])]
    got = values(spark, rows, "t string, q string, e string, o array<string>",
                 A.fits_topic(F.col("t"), F.col("q"), F.col("e"), F.lit(None).cast("string"), F.col("o")))
    assert [g[0] for g in got] == [True, True, False]


QUIZ = [{"id": i, "correct_answer": a, "explanation": f"e{i}"} for i, a in enumerate("abc", 1)]


def test_quiz_grading(spark):
    rows = [(1, 1, "a", 1), (1, 2, "x", 2), (2, 1, "x", 1), (2, 1, "a", 2), (2, 2, "b", 3), (2, 3, "c", 4), (3, 9, "a", 1)]
    answers = spark.createDataFrame(rows, "learner int, question int, answer string, at int")
    review = A.review_answers(QUIZ, answers, "learner", "question", "answer", "at")
    shown = {(r["learner"], r["question_id"]): (r["shown"], r["is_correct"]) for r in review.collect()}
    assert shown[(1, 3)] == ("Unanswered", False) and shown[(2, 1)] == ("a", True) and len(shown) == 9
    graded = {r["learner"]: (r["correct"], r["questions"], r["accuracy"]) for r in A.grade_quiz(review, "learner").collect()}
    assert graded == {1: (1, 3, 33), 2: (3, 3, 100), 3: (0, 3, 0)}


def test_blueprints(spark):
    rows = [("g", ["Python", "SQL"], ["a", "b"]), ("g", ["Python"], ["a"]), ("g", [], ["a", "b", "c"]), ("h", ["R"], [])]
    frame = spark.createDataFrame(rows, "g string, tech array<string>, todo array<string>")
    got = {r["g"]: tuple(r)[1:] for r in A.blueprint_stats(frame, ["g"], "tech", "todo").collect()}
    assert got == {"g": (3, 2.0, 2), "h": (1, 0.0, 1)}
    assert tuple(A.blueprint_stats(frame, [], "tech", "todo").first()) == (4, 1.5, 3)


def test_code_review(spark):
    rows = [("df.dropna()",), ("for i, r in df.iterrows(): pass",), ("x = 1",)]
    got = values(spark, rows, "c string", A.review_code(F.col("c")))
    assert [g[0]["status"] for g in got] == ["Needs Improvement", "Needs Improvement", "Correct"]
    assert "inplace=True" in got[0][0]["line_by_line_feedback"] and "subset" in got[0][0]["line_by_line_feedback"]
    assert got[2][0]["optimized_alternative_code"] == "```python\n# Code is already optimal\nx = 1\n```"


def test_challenges(spark):
    asked = spark.createDataFrame([(1, " SQL ", "Advanced"), (2, "rust", "?")], "id int, language string, level string")
    got = {r["id"]: r["title"] for r in A.find_challenge(asked).collect()}
    assert got == {1: "Active Users Session Analytics", 2: "Reverse Words in a String"}
    rows = [("Python", "Reverse Words in a String", "pass"), ("python", "reverse_words", "pass"), ("python", "reverse_words", "' '.join(s.split())")]
    cols = [F.col(c) for c in ("l", "t", "c")]
    shipped = values(spark, rows, "l string, t string, c string", A.grade_challenge(*cols)["score"], A.grade_challenge(*cols, intended=True)["score"])
    assert shipped == [(95, 70), (70, 70), (95, 95)]
    badges = values(spark, [("Success",), ("Failed",), ("x",)], "s string", A.badge(F.col("s"), V.STATUS_BADGES), A.badge(F.col("s"), V.REVIEW_BADGES))
    assert [b[0] for b in badges] == ["✅ Solved", "❌ Incorrect", "⚠️ Needs Optimization"]


def test_interview_scores(spark):
    pal, gen = V.INTERVIEW_QUESTIONS["python programming"][:2]
    sql = V.INTERVIEW_QUESTIONS["sql databases"][0]
    rows = [
        ("Python Programming", pal, "use lower()"), ("Python Programming", pal, "I would loop"),
        ("python programming", pal, "def f(s): return s"), (" python programming ", gen, "it uses YIELD"),
        ("Python Programming", sql, "limit"), ("SQL Databases", sql, "MAX(x)"), ("cooking", gen, "yield"),
    ]
    got = values(spark, rows, "t string, q string, a string", A.evaluate_answer(F.col("t"), F.col("q"), F.col("a")))
    assert [g[0]["score"] for g in got] == [9, 4, 7, 9, 7, 9, 7]
    assert got[1][0]["clarity"] == V.EVALUATION_DEFAULT[3] and got[1][0]["feedback"].startswith("You should define")


def test_interview_lookup_and_sessions(spark):
    got = values(spark, [("SQL Databases ",), ("x",)], "t string", A.interview_questions(F.col("t")))
    assert got[0][0] == V.INTERVIEW_QUESTIONS["sql databases"] and got[1][0] == V.INTERVIEW_QUESTIONS["python programming"]
    rows = [(1, 9), (1, None), (1, 4), (2, 7), (2, 7), (2, 7), (2, 8)]
    frame = spark.createDataFrame(rows, "s int, score int")
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "s int")
    means = {r["s"]: r["overall_score"] for r in A.assess_sessions(frame, "s", "score", sessions).collect()}
    assert means == {1: 6.7, 2: 7.2, 3: 0.0}  # 7.25 goes to the even digit
    bands = values(spark, [(8.0,), (5.0,), (4.9,)], "x double", A.score_band(F.col("x")))
    assert [b[0] for b in bands] == ["🟢 Strong", "🟡 Average", "🔴 Needs Improvement"]


def test_transcript_uses_shortest_list(spark):
    rows = [(["a", "b"], ["x"], [9, 8], ["ok", "no"]), ([], [], [], [])]
    got = values(spark, rows, "q array<string>, a array<string>, s array<int>, f array<string>",
                 A.transcript(F.col("q"), F.col("a"), F.col("s"), F.col("f")))
    assert got[0][0] == "Q1: a\nStudent Answer: x\nScore: 9/10\nFeedback: ok\n\n" and got[1][0] == ""


def test_spoken(spark):
    got = values(spark, [("My PYTHON",), ("sql?",), ("cats",)], "m string", A.spoken_reply(F.col("m")))
    assert got[0][0]["reply"].startswith("Python is a high-level") and got[1][0]["reply"].startswith("SQL (")
    assert got[2][0]["reply"].startswith("I heard you ask about: 'cats'.")


@pytest.mark.parametrize(
    "raw,ok",
    [('{"a": 1, "b": "x"}', True), ('```json\n{"a": 1, "b": "x"}\n```', True), ('```\n{"a": 1, "b": null}\n```', True),
     ('{"a": 1}', False), ('{"a": 1,', False), ("[]", False), ("", False), (None, False)],
)
def test_parse_object(spark, raw, ok):
    got = values(spark, [(raw,)], "r string", A.parse_object(F.col("r"), "a int, b string", ["a", "b"]))
    assert (got[0][0] is not None) is ok


def test_parse_array(spark):
    rows = [('[{"question": "x"}]',), ("[]",), ('[{"a": 1}]',), ("{}",)]
    got = values(spark, rows, "r string", A.parse_array(F.col("r"), "array<struct<question:string>>", "question"))
    assert [g[0] is not None for g in got] == [True, False, False, False]


def test_projects_with_a_large_bank(spark, monkeypatch):
    from lectern.functions import joins

    bank = spark.createDataFrame(
        [(i, ["beginner", "advanced", "intermediate"][i % 3], "nlp" if i % 2 else "general") for i in range(60)],
        "id int, level string, area string",
    )
    asked = spark.createDataFrame(
        [(1, "for beginners", "NLP tasks"), (2, "hard", "cooking"), (3, "Advanced", "natural language")],
        "rid int, difficulty string, topic string",
    )
    small = sorted((r["rid"], r["id"]) for r in A.find_projects(asked, bank).collect())
    monkeypatch.setattr(joins, "as_broadcast", lambda df: None)
    assert small == sorted((r["rid"], r["id"]) for r in A.find_projects(asked, bank).collect())
    assert len(small) == 30 and (1, 3) in small and (2, 2) in small


def test_model_solutions(spark):
    rows = [("Python", "Reverse Words in a String", "s.split() ' '.join("), ("python", "reverse_words", "pass"),
            ("SQL", "Customers Who Never Order", ""), ("Python", "Find All Anagrams", ""), ("R", "never order", "")]
    frame = spark.createDataFrame(rows, "l string, t string, c string")
    got = [r[0] for r in frame.select(A.grade_challenge(F.col("l"), F.col("t"), F.col("c"), intended=True)["optimal_solution"]).collect()]
    assert got == [V.SOLUTION_REVERSE, V.SOLUTION_SLICING, V.SOLUTIONS[1][2], V.SOLUTIONS[0][2], ""]


def test_project_digests_are_those_of_the_listing(spark):
    areas = [r for _n, r in V.PROJECT_RULES] + [V.PROJECT_DEFAULT]
    bank = [(i, ["beginner", "intermediate", "advanced"][i % 2], areas[i % len(areas)]) for i in range(500)]
    bank = spark.createDataFrame(bank, "item long, level string, area string")
    asked = spark.createDataFrame(
        [(1, "for Beginners", "time series"), (2, "ADVANCED", "Vision"), (3, "?", "cooking"), (4, "for Beginners", None)],
        "id long, difficulty string, topic string",
    )
    listed = {}
    for r in A.find_projects(asked, bank).collect():
        listed.setdefault(r["id"], []).append(r["item"])
    got = {r["id"]: r for r in A.project_digests(asked, bank, "item").collect()}
    assert set(got) == {1, 2, 3, 4} and listed
    import hashlib

    for i, r in got.items():
        own = listed.get(i, [])
        assert r["projects"] == len(own) and r["first_project"] == min(own, default=None)
        hashes = [int(hashlib.md5(str(x).encode()).hexdigest()[:8], 16) for x in own]
        assert r["digest"] == (sum(hashes) if own else None)


def test_project_items_lists_every_blueprint_for_every_turn(spark, tmp_path):
    from lectern.plans.assessment import project_items

    turns = [(c, t, ["user", "assistant", "tool"][(c + t) % 3], "Vision" if c % 2 else "cooking") for c in range(6) for t in range(3)]
    parts = [(i, f"part {i}", i % 4) for i in range(14)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    areas = [r for _n, r in V.PROJECT_RULES] + [V.PROJECT_DEFAULT]
    bank = {}
    for key, title, size in parts:
        if key % 9 < len(areas):
            level = {0: "beginner", 1: "advanced"}.get(size % 3, "intermediate")
            bank.setdefault((level, areas[key % 9]), []).append((key, title))
    got = {}
    for r in project_items(spark, str(tmp_path)).collect():
        got.setdefault((r["conv_id"], r["turn"], r["level"], r["area"], r["projects"], r["first_project"]), []).append((r["p_partkey"], r["title"]))
    assert {k[:2] for k in got} == {(c, t) for c, t, _r, _x in turns} and len(got) == len(turns)
    assert any(k[4] for k in got) and not all(k[4] for k in got)
    for (_c, _t, level, area, n, first), listed in got.items():
        own = bank.get((level, area), [])
        assert n == len(own) and first == min((k for k, _ in own), default=None)
        assert sorted(listed, key=str) == (sorted(own, key=str) or [(None, None)])


def test_large_banks_are_dealt_by_key(spark):
    from lectern.functions.joins import join_few_keys

    bank = spark.createDataFrame([("hot" if i % 10 else "cold", i) for i in range(300)], "key string, item long")
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["hot", "cold", "none", None, "hot"])], "id long, key string")
    few = sorted(map(tuple, join_few_keys(rows, bank, ["key"]).collect()))
    assert sorted(map(tuple, join_few_keys(rows, bank, ["key"], 10, 25).collect())) == few and len(few) == 570


def test_pairs_of_few_keys_are_dealt_on_both_sides(spark, monkeypatch):
    from lectern.functions import joins

    for name, value in (("PART_ROWS", 50), ("SLICE_ROWS", 20), ("TASK_PAIRS", 1_000)):
        monkeypatch.setattr(joins, name, value, raising=False)
    # One key has most rows on both sides; the others are small, null or on one side only. Two rows come twice.
    asking = [(i % 398, "hot") for i in range(400)] + [(1_000, "cold"), (1_001, None), (1_002, "none")]
    bank = [("hot" if i % 10 else "cold", i) for i in range(300)] + [(None, 300), ("unasked", 301), ("cold", 0)]
    want = sorted((i, k, item) for i, k in asking for key, item in bank if key == k is not None)
    rows = spark.createDataFrame(asking, "id long, key string")
    pairs = joins.join_few_keys(rows, spark.createDataFrame(bank, "key string, item long"), ["key"], 10)
    got = pairs.selectExpr("id", "key", "item", "spark_partition_id() AS p").collect()
    assert sorted((r["id"], r["key"], r["item"]) for r in got) == want and pairs.columns == ["key", "id", "item"]
    sizes = {}
    for r in got:
        sizes[r["p"]] = sizes.get(r["p"], 0) + 1
    assert max(sizes.values()) < len(got) / 5 and len(sizes) > 20
