"""Queries for quizzes, projects, submissions, interviews and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.operators import assessment as A
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table

# Opening words put before each conversation turn so that every rule is met.
OPENINGS = [
    "", "Python lists ", "Pandas frames ", "SQL joins ", "Probability ", "Deep Learning ", "natural language ",
    "data viz ", "PySpark ", "Supervised tasks ", "Unsupervised tasks ", "time series ", "Vision ", "Workflow ",
    "Deployment ", "Outliers ", "FastAPI ", "Predictive ",
]
OPENING_SQL = "CASE (conv_id * 7 + turn) % 18 " + " ".join(
    f"WHEN {i} THEN {S.text(o)}" for i, o in enumerate(OPENINGS)
) + " END"
TOPICS_SQL = f"SELECT conv_id, turn, {OPENING_SQL} || text AS topic FROM conversations"

PROJECT_CASE = " ".join(
    f"WHEN {S.contains_any('low', n)}{' AND NOT contains(low, ' + S.text('unsupervised') + ')' if r == 'supervised' else ''} THEN {S.text(r)}"
    for n, r in V.PROJECT_RULES
)


def topics(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "turn", "role", F.expr(f"{OPENING_SQL} || text").alias("topic"))


@query(
    "QZ-1 QZ-3 PJ-1",
    f"""SELECT conv_id, turn, {S.rules('low', V.TOPIC_RULES, V.TOPIC_DEFAULT)} AS topic_key,
          {S.rules('low', V.BANK_RULES, V.BANK_DEFAULT)} AS bank,
          CASE {PROJECT_CASE} ELSE 'general' END AS project,
          CASE role WHEN 'user' THEN 'beginner' WHEN 'assistant' THEN 'advanced' ELSE 'intermediate' END AS difficulty
        FROM (SELECT conv_id, turn, role, lower({OPENING_SQL} || text) AS low FROM conversations)""",
)
def route_topics(spark, sf_dir):
    """Topic, quiz bank, project bank and difficulty of every conversation turn."""
    asked = topics(spark, sf_dir)
    level = F.when(F.col("role") == "user", "for Beginners").when(F.col("role") == "assistant", "ADVANCED").otherwise("?")
    return asked.select(
        "conv_id", "turn",
        A.topic_key(F.col("topic")).alias("topic_key"),
        A.bank_key(F.col("topic")).alias("bank"),
        A.project_key(F.col("topic")).alias("project"),
        A.difficulty_key(level).alias("difficulty"),
    )


_AREAS = [r for _n, r in V.PROJECT_RULES] + [V.PROJECT_DEFAULT]
_AREA_SQL = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {S.text(a)}" for i, a in enumerate(_AREAS)) + " END"
_LEVEL_SQL = "CASE p_size % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'advanced' ELSE 'intermediate' END"


_ASKED_SQL = f"""SELECT conv_id, turn, CASE {PROJECT_CASE} ELSE 'general' END AS area,
          CASE role WHEN 'user' THEN 'beginner' WHEN 'assistant' THEN 'advanced' ELSE 'intermediate' END AS level
        FROM (SELECT conv_id, turn, role, lower({OPENING_SQL} || text) AS low FROM conversations)"""
_BANK_SQL = f"SELECT p_partkey, p_name AS title, {_AREA_SQL} AS area, {_LEVEL_SQL} AS level FROM part"


def _project_requests(spark, sf_dir):
    level = F.when(F.col("role") == "user", "for Beginners").when(F.col("role") == "assistant", "ADVANCED").otherwise("?")
    return topics(spark, sf_dir).withColumn("difficulty", level)


def _project_bank(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.expr(_AREA_SQL).alias("area"), F.expr(_LEVEL_SQL).alias("level")
    )


@query(
    "PJ-1",
    f"""WITH asked AS ({_ASKED_SQL}), bank AS ({_BANK_SQL}),
    hashed AS (SELECT level, area, p_partkey, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT AS h FROM bank),
    sums AS (SELECT level, area, count(p_partkey) AS projects, min(p_partkey) AS first_project, sum(h)::BIGINT AS digest
             FROM hashed GROUP BY level, area)
    SELECT conv_id, turn, level, area, coalesce(projects, 0) AS projects, first_project, digest, p_partkey, title
    FROM asked LEFT JOIN sums USING (level, area) LEFT JOIN bank USING (level, area)""",
)
def project_items(spark, sf_dir):
    """Every blueprint for every conversation turn, with every part for a blueprint, and their number, least and digest."""
    bank = _project_bank(spark, sf_dir)
    found = A.project_digests(_project_requests(spark, sf_dir), bank, "p_partkey")
    listed = A.find_projects(found, bank)
    none = [F.lit(None).cast(bank.schema[c].dataType).alias(c) for c in ("p_partkey", "title")]
    columns = ["conv_id", "turn", "level", "area", "projects", "first_project", "digest"]
    without = found.filter("projects = 0").select(*columns, *none)
    return listed.select(*columns, "p_partkey", "title").unionByName(without)


@query(
    "PJ-1",
    f"""WITH asked AS (SELECT level, area, min(struct_pack(conv_id := conv_id, turn := turn)) AS f, count(*) AS requests
                   FROM ({_ASKED_SQL}) GROUP BY level, area), bank AS ({_BANK_SQL})
    SELECT f.conv_id AS conv_id, f.turn AS turn, requests, level, area, p_partkey, title FROM asked JOIN bank USING (level, area)""",
)
def project_listing(spark, sf_dir):
    """Every blueprint that was asked for, listed for the first of the turns that ask alike, with their number."""
    asked = _project_requests(spark, sf_dir)
    keyed = asked.select("conv_id", "turn", "topic", "difficulty").groupBy(
        A.difficulty_key(F.col("difficulty")).alias("k"), A.project_key(F.col("topic")).alias("a")
    ).agg(
        F.min(F.struct("conv_id", "turn", "topic", "difficulty")).alias("f"), F.count(F.lit(1)).alias("requests")
    ).select("f.*", "requests")
    found = A.find_projects(keyed, _project_bank(spark, sf_dir))
    return found.select("conv_id", "turn", "requests", "level", "area", "p_partkey", "title")


_QUIZ_CASE = " ".join(
    f"WHEN {S.text(k)} THEN [{', '.join(S.text(w) for w in words)}]" for k, words in V.TOPIC_KEYWORDS.items()
)


@query(
    "QZ-2",
    f"""WITH items AS (
      SELECT conv_id, turn, {OPENING_SQL} AS topic, text AS question,
             CASE turn % 3 WHEN 0 THEN 'Use a LIST' WHEN 1 THEN 'a Plot shows it' END AS explanation,
             ['Merge', 'Neural net', role] AS options FROM conversations),
    keyed AS (SELECT *, CASE {S.rules('lower(topic)', V.TOPIC_RULES, V.TOPIC_DEFAULT)} {_QUIZ_CASE} END AS words FROM items)
    SELECT conv_id, turn FROM keyed
    WHERE len(list_filter(words, lambda w: contains(
            lower(question || ' ' || coalesce(explanation, '') || ' ' || 'Token'), w)
          OR contains(lower(array_to_string(options, ' ')), w))) > 0""",
)
def fitting_items(spark, sf_dir):
    """Turns taken as quiz items: those that fit the topic they open with."""
    items = spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", F.expr(OPENING_SQL).alias("topic"), F.col("text").alias("question"),
        F.expr("CASE turn % 3 WHEN 0 THEN 'Use a LIST' WHEN 1 THEN 'a Plot shows it' END").alias("explanation"),
        F.array(F.lit("Merge"), F.lit("Neural net"), F.col("role")).alias("options"),
    )
    fits = A.fits_topic(F.col("topic"), F.col("question"), F.col("explanation"), F.lit("Token"), F.col("options"))
    return items.filter(fits).select("conv_id", "turn")


# A small question bank of our own, one item per bank.
BANK = [
    ("workflows", "Which step reads the raw files?", "ingestion"),
    ("exploration", "Which plot shows quartiles?", "box plot"),
    ("modeling", "Which loss does least squares use?", "squared error"),
    ("deployment", "What pins library versions?", "a lock file"),
    ("python", "Which type cannot change?", "tuple"),
    ("pandas", "Which call fills gaps?", "fillna"),
    ("sql", "Which clause filters groups?", "having"),
    ("statistics", "What is the middle value?", "median"),
    ("deep learning", "What does relu do below zero?", "returns zero"),
    ("nlp", "What is a word piece?", "token"),
    ("visualization", "Which chart shows a share?", "bar"),
    ("big data", "What moves rows between tasks?", "shuffle"),
    ("machine learning", "What hides in the test set?", "generalization"),
    ("general", "What is a table of rows?", "data frame"),
]
BANK_VALUES = ", ".join("(" + ", ".join(S.text(x) for x in b) + ")" for b in BANK)


@query(
    "QZ-3",
    f"""WITH b AS (SELECT * FROM (VALUES {BANK_VALUES}) AS v(bank, question, answer)),
    t AS (SELECT conv_id, turn, {S.rules('lower(topic)', V.BANK_RULES, V.BANK_DEFAULT)} AS bank FROM ({TOPICS_SQL}))
    SELECT conv_id, turn, bank, question, answer FROM t JOIN b USING (bank)""",
)
def quiz_items(spark, sf_dir):
    """Question bank items for the topic of every conversation turn."""
    bank = spark.createDataFrame(BANK, "bank string, question string, answer string")
    found = A.find_items(topics(spark, sf_dir), bank, A.bank_key(F.col("topic")))
    return found.select("conv_id", "turn", "bank", "question", "answer")


ITEMS_SQL = """CASE event_id % 4
    WHEN 0 THEN '```json' || chr(10) || '[{"question": "a Tuple ' || event_id || '", "options": ["x"], "correct_answer": "y", "explanation": "z"}, {"question": "none", "options": ["q"], "correct_answer": "q", "explanation": "q"}]' || chr(10) || '```'
    WHEN 1 THEN '[{"question": "none", "options": ["q"], "correct_answer": "q"}]'
    WHEN 2 THEN '[]' ELSE 'no json ' || event_id END"""


@query(
    "JS-1 JS-2 QZ-2 QZ-3",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'reply' ELSE 'bank' END AS origin,
         CASE event_id % 4 WHEN 0 THEN 'a Tuple ' || event_id ELSE 'Which type cannot change?' END AS question FROM events""",
)
def generated_quizzes(spark, sf_dir):
    """Quiz replies parsed and filtered by topic; an unusable reply falls back to the bank."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(ITEMS_SQL).alias("raw"), F.concat(F.lit("Python for "), "event_type").alias("topic"))
    item = "array<struct<question:string,options:array<string>,correct_answer:string,explanation:string>>"
    fitting = raw.withColumn("items", A.topic_items(F.col("topic"), A.parse_array(F.col("raw"), item)))
    bank = spark.createDataFrame(BANK, "bank string, question string, answer string")
    joined = A.find_items(fitting, bank, A.bank_key(F.col("topic")))
    usable = F.coalesce(F.size("items"), F.lit(0)) > 0
    return joined.select(
        "event_id", F.when(usable, "reply").otherwise("bank").alias("origin"),
        F.when(usable, F.col("items")[0]["question"]).otherwise(F.col("question")).alias("question"),
    )


@query(
    "JS-2 CR-1",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Incorrect' WHEN event_type IN ('click', 'view', 'purchase')
         THEN 'Needs Improvement' ELSE 'Correct' END AS status,
         CASE WHEN event_id % 3 = 0 THEN '❌' WHEN event_type IN ('click', 'view', 'purchase') THEN '⚠️' ELSE '✅' END AS badge
       FROM events""",
)
def replied_reviews(spark, sf_dir):
    """Code reviews taken from a model reply where it holds all four keys, else from the rules."""
    fields = list(V.REVIEW_FINE)
    full = "{" + ", ".join(f'"{f}": "{"Incorrect" if f == "status" else "x"}"' for f in fields) + "}"
    code = table(spark, sf_dir, "events").select(
        "event_id", F.expr(CODE_SQL).alias("code"),
        F.when(F.col("event_id") % 3 == 0, F.lit(full)).when(F.col("event_id") % 3 == 1, F.lit('{"status": "x"}')).alias("raw"),
    )
    shape = ", ".join(f"{f} string" for f in fields)
    review = F.coalesce(A.parse_object(F.col("raw"), shape, fields), A.review_code(F.col("code")))
    status = code.select("event_id", review.alias("r")).select("event_id", F.col("r.status").alias("status"))
    return status.withColumn("badge", A.badge(F.col("status"), V.REVIEW_BADGES))


QUIZ = [
    {"id": 0, "correct_answer": "click", "explanation": "Zero goes with click."},
    {"id": 1, "correct_answer": "view", "explanation": "One goes with view."},
    {"id": 2, "correct_answer": "purchase", "explanation": "Two goes with purchase."},
    {"id": 3, "correct_answer": "error", "explanation": "Three goes with error."},
    {"id": 4, "correct_answer": "signup", "explanation": "Four goes with signup."},
    {"id": 50, "correct_answer": "none", "explanation": "Nobody answers this one."},
]
QUIZ_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({q['id']}, {S.text(q['correct_answer'])}, {S.text(q['explanation'])})" for q in QUIZ
) + ") AS v(question_id, correct_answer, explanation)"
REVIEW_SQL = f"""
quiz AS ({QUIZ_SQL}),
given AS (SELECT user_id, json_extract_string(props, '$.k')::INTEGER % 7 AS question_id, event_type, event_id FROM events),
last AS (SELECT user_id, question_id, arg_max(event_type, event_id) AS answer FROM given GROUP BY ALL),
review AS (SELECT u.user_id, q.question_id, q.correct_answer, q.explanation, l.answer
           FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN quiz q LEFT JOIN last l USING (user_id, question_id))"""


def reviewed(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type",
        (F.get_json_object("props", "$.k").cast("int") % 7).alias("question"),
    )
    return A.review_answers(QUIZ, answers, "user_id", "question", "event_type", "event_id")


@query(
    "QZ-5",
    f"""WITH {REVIEW_SQL} SELECT user_id, question_id, coalesce(answer, 'Unanswered') AS shown,
        answer IS NOT DISTINCT FROM correct_answer AS is_correct, explanation FROM review""",
)
def quiz_review(spark, sf_dir):
    return reviewed(spark, sf_dir)


@query(
    "QZ-4",
    f"""WITH {REVIEW_SQL}, c AS (SELECT user_id, count(*) FILTER (answer = correct_answer) AS correct,
        count(*) AS questions FROM review GROUP BY user_id)
    SELECT *, CAST(floor(CAST(correct AS DOUBLE) / questions * 100) AS INTEGER) AS accuracy FROM c""",
)
def grade_quiz(spark, sf_dir):
    """Each user's last answers to a six-question quiz, graded."""
    return A.grade_quiz(reviewed(spark, sf_dir), "user_id")


@query(
    "PJ-2",
    """WITH b AS (SELECT p_brand, p_type, list_append(string_split(p_name, ' '), lower(p_type)) AS tech,
                         p_size % 7 AS n FROM part),
    t AS (SELECT p_brand, count(DISTINCT x) AS technologies FROM (SELECT p_brand, unnest(tech) AS x FROM b) GROUP BY 1)
    SELECT p_brand, count(*) AS blueprints, CAST(format('{:.1f}', sum(n) / CAST(count(*) AS DOUBLE)) AS DOUBLE) AS avg_deliverables,
           any_value(technologies) AS technologies
    FROM b JOIN t USING (p_brand) GROUP BY p_brand""",
)
def blueprint_stats(spark, sf_dir):
    """Parts as blueprints: words of the name are technologies, the size gives the deliverables."""
    blueprints = table(spark, sf_dir, "part").select(
        "p_brand",
        F.array_append(F.split("p_name", " "), F.lower("p_type")).alias("tech"),
        F.array_repeat("p_name", (F.col("p_size") % 7)).alias("deliverables"),
    )
    return A.blueprint_stats(blueprints, ["p_brand"], "tech", "deliverables")


CODE_SQL = """CASE event_type WHEN 'click' THEN '  df.DropNA()  # ' || event_id
    WHEN 'view' THEN 'for INDEX, row in df.iterrows(): pass # ' || event_id
    WHEN 'purchase' THEN 'for r in df.itertuples(): print(' || event_id || ')'
    WHEN 'error' THEN 'x = ' || event_id ELSE 'df = df.fillna(' || event_id || ')' END"""


def _review_sql(field: str) -> str:
    fine = V.REVIEW_FINE[field]
    last = S.text(fine)
    if "%s" in fine:
        a, b = fine.split("%s")
        last = f"{S.text(a)} || code || {S.text(b)}"
    return f"""CASE WHEN event_type = 'click' THEN {S.text(V.REVIEW_DROPNA[field])}
        WHEN event_type IN ('view', 'purchase') THEN {S.text(V.REVIEW_LOOP[field])} ELSE {last} END AS {field}"""


@query(
    "CR-1 CR-4",
    f"""SELECT event_id, {', '.join(_review_sql(f) for f in V.REVIEW_FINE)},
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '⚠️' ELSE '✅' END AS badge
        FROM (SELECT event_id, event_type, {CODE_SQL} AS code FROM events)""",
)
def code_reviews(spark, sf_dir):
    """A code submission per event, reviewed; the SQL knows which kind each one is."""
    code = table(spark, sf_dir, "events").select("event_id", F.expr(CODE_SQL).alias("code"))
    reviewed_code = code.select("event_id", A.review_code(F.col("code")).alias("r")).select("event_id", "r.*")
    return reviewed_code.withColumn("badge", A.badge(F.col("status"), V.REVIEW_BADGES))


@query(
    "CR-2 CR-3 CR-4",
    f"""WITH bank AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(S.text(x) for x in c) + ')' for c in V.CHALLENGES)})
          AS v(l, v, title, sample_input, sample_output, learning_objective)),
    asked AS (
      SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' WHEN 2 THEN 'data analysis' ELSE 'python' END AS l,
             CASE user_id % 4 WHEN 0 THEN ' Python' WHEN 1 THEN 'SQL' WHEN 2 THEN 'Data Analysis ' ELSE 'Rust' END AS language,
             CASE event_id % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' ELSE 'beginner' END AS v,
             event_type IN ('click', 'view') AS neat FROM events)
    SELECT event_id, language, title, sample_output, learning_objective,
      CASE WHEN a.l = 'python' AND language <> 'Rust' AND a.v = 'beginner' AND NOT neat THEN 'Needs Optimization' ELSE 'Success' END AS status,
      CASE WHEN a.l = 'python' AND language <> 'Rust' AND a.v = 'beginner' AND NOT neat THEN 70 ELSE 95 END AS score,
      95 AS shipped_score,
      CASE WHEN a.l = 'python' AND language <> 'Rust' AND a.v = 'beginner' AND NOT neat THEN '⚠️ Needs Optimization' ELSE '✅ Solved' END AS badge,
      CASE WHEN a.l = 'python' AND language <> 'Rust' AND a.v = 'beginner' THEN
                CASE WHEN neat THEN {S.text(V.SOLUTION_REVERSE)} ELSE {S.text(V.SOLUTION_SLICING)} END
           WHEN a.l = 'python' AND language <> 'Rust' AND a.v = 'intermediate' THEN {S.text(V.SOLUTIONS[0][2])}
           WHEN a.l = 'sql' AND a.v = 'beginner' THEN {S.text(V.SOLUTIONS[1][2])}
           WHEN a.l = 'sql' AND a.v = 'intermediate' THEN {S.text(V.SOLUTIONS[2][2])} ELSE '' END AS optimal_solution
    FROM asked a JOIN bank b ON a.l = b.l AND a.v = b.v""",
)
def graded_challenges(spark, sf_dir):
    """A challenge attempt per event: looked up, graded by the shipped and by the intended title rule."""
    asked = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("CASE user_id % 4 WHEN 0 THEN ' Python' WHEN 1 THEN 'SQL' WHEN 2 THEN 'Data Analysis ' ELSE 'Rust' END").alias("language"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'INTERMEDIATE' WHEN 2 THEN 'advanced ' ELSE 'expert' END").alias("level"),
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'return \" \".JOIN(s.split()[::-1])' ELSE 'pass' END").alias("code"),
    )
    found = A.find_challenge(asked)
    columns = [F.col(c) for c in ("language", "title", "code")]
    graded = found.withColumn("g", A.grade_challenge(*columns, intended=True)).withColumn(
        "shipped_score", A.grade_challenge(*columns)["score"]
    )
    return graded.select(
        "event_id", "language", "title", "sample_output", "learning_objective",
        F.col("g.status").alias("status"), F.col("g.score").alias("score"), "shipped_score",
        A.badge(F.col("g.status"), V.STATUS_BADGES).alias("badge"), F.col("g.optimal_solution").alias("optimal_solution"),
    )


ANSWER_SQL = """CASE event_type WHEN 'click' THEN 'def f(s): return s.Lower()[::-1]' WHEN 'view' THEN 'def g(): YIELD 1'
    WHEN 'purchase' THEN 'order by salary limit 1 OFFSET 1' WHEN 'error' THEN 'we Reject the NULL hypothesis'
    ELSE 'it may overfit or underfit' END"""
TOPIC_SQL = """CASE user_id % 5 WHEN 0 THEN ' Python Programming' WHEN 1 THEN 'SQL Databases' WHEN 2 THEN 'Machine Learning '
    WHEN 3 THEN 'Statistics & Probability' ELSE 'Cooking' END"""
_BANK_SQL = ", ".join(
    f"({i}, {q}, {S.text(text)})"
    for i, name in enumerate([*V.INTERVIEW_QUESTIONS, V.INTERVIEW_DEFAULT])
    for q, text in enumerate(V.INTERVIEW_QUESTIONS[name])
)
# (user_id % 5, question, event types that hit, rule)
_HITS = [(0, 0, "('click')", 0), (0, 1, "('view')", 1), (1, 0, "('purchase')", 2), (2, 0, "('signup')", 3), (3, 0, "('error')", 4)]


def _evaluation_sql(pos: int) -> str:
    whens = " ".join(
        f"WHEN t = {tt} AND q = {qq} AND event_type IN {types} THEN {S.text(str(V.EVALUATION_RULES[r][3 + pos]))}"
        for tt, qq, types, r in _HITS
    )
    if pos < 3:
        whens += f" WHEN t = 0 AND q = 0 AND event_type <> 'view' THEN {S.text(str(V.EVALUATION_NO_FUNCTION[pos]))}"
    return f"CASE {whens} ELSE {S.text(str(V.EVALUATION_DEFAULT[pos]))} END"


SCORED_SQL = f"""
bank AS (SELECT * FROM (VALUES {_BANK_SQL}) AS v(t, q, question)),
given AS (SELECT event_id, user_id, event_type, user_id % 5 AS t, event_id % 3 AS q FROM events),
scored AS (SELECT event_id, user_id, question, CAST({_evaluation_sql(0)} AS INTEGER) AS score,
           {', '.join(f'{_evaluation_sql(i + 1)} AS {n}' for i, n in enumerate(V.EVALUATION_FIELDS))}
           FROM given JOIN bank USING (t, q))"""


def scored_answers(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.expr(TOPIC_SQL).alias("topic"), F.expr(ANSWER_SQL).alias("answer"),
        (F.col("event_id") % 3).cast("int").alias("q"),
    )
    asked = answers.withColumn("question", F.get(A.interview_questions(F.col("topic")), F.col("q")))
    evaluated = asked.withColumn("e", A.evaluate_answer(F.col("topic"), F.col("question"), F.col("answer")))
    return evaluated.select("event_id", "user_id", "question", "e.*")


@query("IV-1 IV-2", f"WITH {SCORED_SQL} SELECT * FROM scored")
def score_answers(spark, sf_dir):
    """An interview answer per event; the SQL states which answers hit which rule."""
    return scored_answers(spark, sf_dir)


@query(
    "IV-3 IV-4",
    f"""WITH {SCORED_SQL}, means AS (
      SELECT user_id, CAST(format('{{:.1f}}', sum(coalesce(CASE WHEN event_id % 13 <> 0 THEN score END, 7)) / CAST(count(*) AS DOUBLE)) AS DOUBLE)
             AS overall_score FROM scored GROUP BY user_id)
    SELECT user_id, overall_score, CASE WHEN overall_score >= 8 THEN '🟢 Strong' WHEN overall_score >= 5 THEN '🟡 Average'
           ELSE '🔴 Needs Improvement' END AS band, {S.text(V.ASSESSMENT_STRENGTHS)} AS strengths,
           {S.text(V.ASSESSMENT_WEAKNESSES)} AS weaknesses, {S.text(V.ASSESSMENT_SUGGESTIONS)} AS suggestions FROM means""",
)
def session_scores(spark, sf_dir):
    """Interview result per user; every thirteenth score is missing and counts as the default."""
    scored = scored_answers(spark, sf_dir).withColumn(
        "score", F.when(F.col("event_id") % 13 != 0, F.col("score"))
    )
    assessed = A.assess_sessions(scored, "user_id", "score")
    return assessed.withColumn("band", A.score_band(F.col("overall_score")))


@query(
    "IV-5",
    f"""WITH lists AS (SELECT conv_id, turn, {S.sentences('text')} AS q, {S.words('text')} AS a,
                       range(turn, turn + 4) AS s FROM conversations)
    SELECT conv_id, turn, coalesce(array_to_string(list_transform(range(1, least(len(q), len(a), len(s)) + 1),
      lambda i: 'Q' || i || ': ' || q[i] || chr(10) || 'Student Answer: ' || a[i] || chr(10) || 'Score: ' || s[i]
        || '/10' || chr(10) || 'Feedback: ' || a[len(a)] || chr(10) || chr(10)), ''), '') AS transcript
    FROM lists""",
)
def transcripts(spark, sf_dir):
    """Numbered transcript per turn: sentences as questions, words as answers, four scores."""
    from lectern.functions import text as T

    turns = spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", T.sentences(F.col("text")).alias("q"), T.words(F.col("text")).alias("a"),
        F.sequence(F.col("turn"), F.col("turn") + 3).alias("s"),
    )
    remark = F.transform("a", lambda _w: F.try_element_at("a", F.lit(-1)))
    text = A.transcript(F.col("q"), F.col("a"), F.col("s"), remark)
    return turns.select("conv_id", "turn", text.alias("transcript"))


def _spoken_sql(pos: int) -> str:
    a, b = V.SPOKEN_REPLIES["other"][pos].split("%s")
    return f"""CASE WHEN contains(lower(topic), 'python') THEN {S.text(V.SPOKEN_REPLIES['python'][pos])}
        WHEN contains(lower(topic), 'sql') THEN {S.text(V.SPOKEN_REPLIES['sql'][pos])}
        ELSE {S.text(a)} || topic || {S.text(b)} END"""


@query(
    "VM-1",
    f"SELECT conv_id, turn, {_spoken_sql(0)} AS reply, {_spoken_sql(1)} AS spoken_reply FROM ({TOPICS_SQL})",
)
def spoken_replies(spark, sf_dir):
    replies = topics(spark, sf_dir).select("conv_id", "turn", A.spoken_reply(F.col("topic")).alias("r"))
    return replies.select("conv_id", "turn", "r.*")


RAW_SQL = """CASE event_id % 7
    WHEN 0 THEN '{"status": "Correct", "score": ' || user_id || ', "extra": ' || props || '}'
    WHEN 1 THEN '```json' || chr(10) || '{"status": "Fenced", "score": ' || user_id || '}' || chr(10) || '```'
    WHEN 2 THEN '  ```' || chr(10) || '{"status": null, "score": ' || user_id || '}' || chr(10) || '```  '
    WHEN 3 THEN '{"status": "No score"}'
    WHEN 4 THEN '{"status": "Broken", '
    WHEN 5 THEN '[]'
    ELSE '[{"status": "First", "score": ' || user_id || '}, {"score": 2}]' END"""


@query(
    "JS-1 JS-2",
    """SELECT event_id, event_id % 7 IN (0, 1, 2) AS parsed,
         CASE event_id % 7 WHEN 0 THEN 'Correct' WHEN 1 THEN 'Fenced' WHEN 2 THEN NULL ELSE 'Fallback' END AS status,
         CASE WHEN event_id % 7 IN (0, 1, 2) THEN user_id ELSE 7 END AS score,
         CAST(CASE event_id % 7 WHEN 6 THEN 2 ELSE 0 END AS INTEGER) AS items
       FROM events""",
)
def parse_replies(spark, sf_dir):
    """Replies of seven shapes parsed as an object with required keys and as an array; the rest falls back."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(RAW_SQL).alias("raw"))
    shape = "status string, score bigint"
    parsed = raw.withColumn("o", A.parse_object(F.col("raw"), shape, ["status", "score"])).withColumn(
        "a", A.parse_array(F.col("raw"), f"array<struct<status:string,score:bigint>>", "status")
    )
    ok = F.col("o").isNotNull()
    return parsed.select(
        "event_id", ok.alias("parsed"),
        F.when(ok, F.col("o.status")).otherwise("Fallback").alias("status"),
        F.when(ok, F.col("o.score")).otherwise(7).alias("score"),
        F.coalesce(F.size("a"), F.lit(0)).alias("items"),
    )
