"""Quizzes, projects, submissions, interviews and model replies scored by rules (QZ PJ CR IV VM JS).

The rule tables are short constants, so they are applied as CASE expressions on each row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern import fixed_values as V
from lectern.functions import text as T
from lectern.functions.binding import let
from lectern.functions.bounded import broadcast_if_small
from lectern.functions.joins import join_few_keys
from lectern.functions.rounding import half_even

# ------------------------------------------------------------------------------------ quizzes


def topic_key(topic: Column) -> Column:
    """Topic name normalised to one of nine keys (QZ-1)."""
    return T.first_match(F.lower(topic), V.TOPIC_RULES, V.TOPIC_DEFAULT)


def bank_key(topic: Column) -> Column:
    """Question bank for a topic; the order of the rules matters (QZ-3)."""
    return T.first_match(F.lower(topic), V.BANK_RULES, V.BANK_DEFAULT)


def topic_keywords(key: Column) -> Column:
    out = None
    for name, words in V.TOPIC_KEYWORDS.items():
        hit = key == name
        value = F.array(*[F.lit(w) for w in words])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def fits_topic(topic: Column, question: Column, explanation: Column, answer: Column, options: Column) -> Column:
    """A topic keyword occurs in the question, explanation and answer, or in the options (QZ-2)."""

    def plain(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    body = F.lower(F.concat_ws(" ", plain(question), plain(explanation), plain(answer)))
    listed = F.lower(F.array_join(F.coalesce(options, F.array().cast("array<string>")), " "))
    return let(
        F.struct(body.alias("body"), listed.alias("listed")),
        lambda t: F.exists(
            topic_keywords(topic_key(topic)), lambda w: F.contains(t["body"], w) | F.contains(t["listed"], w)
        ),
    )


def topic_items(topic: Column, items: Column) -> Column:
    """Those quiz items of an array that fit the topic (QZ-2); fields as in a parsed reply."""
    return F.filter(
        items,
        lambda i: fits_topic(topic, i["question"], i["explanation"], i["correct_answer"], i["options"]),
    )


def find_items(requests: DataFrame, bank: DataFrame, key: Column, bank_key: str = "bank") -> DataFrame:
    """Requests joined with the items of their bank (QZ-3); the bank is broadcast when proven small, else salted."""
    return join_few_keys(requests.withColumn(bank_key, key), bank, [bank_key])


def review_answers(items: list[dict], answers: DataFrame, learner: str, question: str, answer: str, order: str) -> DataFrame:
    """One row per learner and question of the quiz (QZ-5): ``shown``, ``is_correct``, ``explanation``.

    The last answer to a question counts. The quiz itself is a parameter, so each question is one aggregate
    and all of them share one shuffle, with one partial row per learner and task.
    """
    lasts = [
        F.max_by(answer, F.when(F.col(question) == i["id"], F.col(order))).alias(f"_a{n}") for n, i in enumerate(items)
    ]
    quiz = F.array(
        *[
            F.struct(
                F.lit(i["id"]).alias("id"), F.lit(i["correct_answer"]).alias("correct_answer"),
                F.lit(i["explanation"]).alias("explanation"), F.col(f"_a{n}").alias("given"),
            )
            for n, i in enumerate(items)
        ]
    )
    rows = answers.groupBy(learner).agg(*lasts).select(learner, F.explode(quiz).alias("_q"))
    given = F.col("_q.given")
    return rows.select(
        learner,
        F.col("_q.id").alias("question_id"),
        F.when(F.coalesce(given, F.lit("")) == "", F.lit("Unanswered")).otherwise(given).alias("shown"),
        given.eqNullSafe(F.col("_q.correct_answer")).alias("is_correct"),
        F.col("_q.explanation").alias("explanation"),
    )


def grade_quiz(review: DataFrame, learner: str) -> DataFrame:
    """Correct count, question count and truncated accuracy per learner (QZ-4)."""
    counted = review.groupBy(learner).agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("questions")
    )
    share = F.try_divide(F.col("correct").cast("double"), F.col("questions"))
    return counted.withColumn("accuracy", F.coalesce(share * 100, F.lit(0.0)).cast("int"))


# ----------------------------------------------------------------------------------- projects


def difficulty_key(difficulty: Column) -> Column:
    return T.first_match(F.lower(difficulty), V.DIFFICULTY_RULES, V.DIFFICULTY_DEFAULT)


def project_key(topic: Column) -> Column:
    """Project bank for a topic (PJ-1). "unsupervised" holds "supervised", so that rule excludes it."""
    low = F.lower(topic)
    out = None
    for needles, result in V.PROJECT_RULES:
        hit = T.contains_any(low, needles)
        if result == "supervised":
            hit = hit & ~F.contains(low, F.lit("unsupervised"))
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(V.PROJECT_DEFAULT))


def find_projects(
    requests: DataFrame, bank: DataFrame, difficulty: str = "difficulty", topic: str = "topic",
    level: str = "level", area: str = "area",
) -> DataFrame:
    """Requests joined with the blueprints of their difficulty and topic (PJ-1).

    ``bank`` names its rows by ``level`` (beginner, intermediate, advanced) and ``area`` (the keys of
    ``project_key``).
    """
    keyed = requests.withColumn(level, difficulty_key(F.col(difficulty))).withColumn(area, project_key(F.col(topic)))
    return join_few_keys(keyed, bank, [level, area])


def project_digests(
    requests: DataFrame, bank: DataFrame, item: str, difficulty: str = "difficulty", topic: str = "topic",
    level: str = "level", area: str = "area",
) -> DataFrame:
    """Per request what ``find_projects`` would list, without listing it: ``projects``, ``first_project``, ``digest``.

    The bank is added up per level and area before the join: number and least of its items, and the sum of their
    32-bit hashes, which is the same in any order. So the output has one row per request however large the bank is.
    Requests without a blueprint have 0 projects and nulls.
    """
    hashed = F.conv(F.substring(F.md5(F.col(item).cast("string")), 1, 8), 16, 10).cast("bigint")
    sums = bank.groupBy(level, area).agg(
        F.count(item).alias("projects"), F.min(item).alias("first_project"), F.sum(hashed).alias("digest")
    )
    keyed = requests.withColumn(level, difficulty_key(F.col(difficulty))).withColumn(area, project_key(F.col(topic)))
    # Three levels and nine areas.
    return keyed.join(broadcast_if_small(sums), [level, area], "left").fillna(0, ["projects"])


def blueprint_stats(blueprints: DataFrame, group: list[str], tech: str, deliverables: str) -> DataFrame:
    """Blueprints, mean deliverables to one decimal, distinct technologies (PJ-2)."""
    sizes = blueprints.groupBy(*group).agg(
        F.count(F.lit(1)).alias("blueprints"), F.sum(F.size(deliverables)).alias("_total")
    )
    names = (
        blueprints.select(*group, F.explode(tech).alias("_tech")).distinct()
        .groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    )
    joined = sizes.join(names, group, "left") if group else sizes.withColumn(
        "_n", blueprints.select(F.explode(tech).alias("_tech")).distinct().agg(F.count(F.lit(1))).scalar()
    )
    mean = F.col("_total") / F.greatest(F.col("blueprints"), F.lit(1))
    return joined.select(
        *group, "blueprints", half_even(mean, 1).alias("avg_deliverables"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("technologies"),
    )


# -------------------------------------------------------------------------------- submissions


def review_code(code: Column) -> Column:
    """Struct with the four review fields (CR-1)."""
    low = F.lower(T.strip(code))
    dropna, loop = F.contains(low, F.lit("dropna")), T.contains_any(low, V.LOOP_MARKS)

    def field(name: str) -> Column:
        fine = F.format_string(V.REVIEW_FINE[name], code) if "%s" in V.REVIEW_FINE[name] else F.lit(V.REVIEW_FINE[name])
        return (
            F.when(dropna, F.lit(V.REVIEW_DROPNA[name])).when(loop, F.lit(V.REVIEW_LOOP[name])).otherwise(fine)
        ).alias(name)

    return F.struct(*[field(n) for n in V.REVIEW_FINE])


def grade_challenge(language: Column, title: Column, code: Column, intended: bool = False) -> Column:
    """Struct ``status, score, feedback, optimal_solution`` (CR-2); no model solution is an empty text.

    The slicing rule looks for "reverse_words" in the title, which the shipped title "Reverse Words in a
    String" never holds; ``intended`` also accepts "reverse words".
    """
    lang, name, low = F.lower(T.strip(language)), F.lower(title), F.lower(code)
    wanted = F.contains(name, F.lit("reverse_words"))
    if intended:
        wanted = wanted | F.contains(name, F.lit("reverse words"))
    plain = ~(F.contains(low, F.lit("split(")) & F.contains(low, F.lit("join(")))
    python = F.contains(lang, F.lit("python"))
    weak = python & wanted & plain
    names = ("status", "score", "feedback")
    optimal = F.when(weak, F.lit(V.SOLUTION_SLICING)).when(python & wanted, F.lit(V.SOLUTION_REVERSE))
    for of, words, solution in V.SOLUTIONS:
        # The first language named in the entry decides, and python is looked for first.
        there = F.contains(lang, F.lit(of)) if of == "python" else ~python & F.contains(lang, F.lit(of))
        optimal = optimal.when(there & F.contains(name, F.lit(words)), F.lit(solution))
    return F.struct(
        *[
            F.when(weak, F.lit(a)).otherwise(F.lit(b)).alias(n)
            for n, a, b in zip(names, V.GRADE_SLICING, V.GRADE_DEFAULT, strict=True)
        ],
        optimal.otherwise(F.lit("")).alias("optimal_solution"),
    )


CHALLENGE_SCHEMA = (
    "language string, level string, title string, sample_input string, sample_output string, learning_objective string"
)


def find_challenge(requests: DataFrame, language: str = "language", level: str = "level") -> DataFrame:
    """Challenge by language and level; unknown ones fall back to python and beginner (CR-3).

    The bank has nine rows, a fixed size, so it is broadcast.
    """
    spark = requests.sparkSession
    bank = F.broadcast(
        spark.createDataFrame(V.CHALLENGES, CHALLENGE_SCHEMA)
        .withColumnRenamed("language", "_language").withColumnRenamed("level", "_level")
    )
    lang, lev = F.lower(T.strip(F.col(language))), F.lower(T.strip(F.col(level)))
    keyed = requests.withColumn(
        "_language", F.when(lang.isin(V.CHALLENGE_LANGUAGES), lang).otherwise("python")
    ).withColumn("_level", F.when(lev.isin(V.CHALLENGE_LEVELS), lev).otherwise("beginner"))
    return keyed.join(bank, ["_language", "_level"], "left").drop("_language", "_level")


def badge(status: Column, table: dict) -> Column:
    """Badge of a status, with a default for the rest (CR-4)."""
    out = None
    for name, text in table.items():
        if name is not None:
            out = F.when(status == name, F.lit(text)) if out is None else out.when(status == name, F.lit(text))
    return out.otherwise(F.lit(table[None]))


# --------------------------------------------------------------------------------- interviews


def interview_questions(topic: Column) -> Column:
    """Question list for an exact topic name, python by default (IV-1)."""
    low = F.lower(T.strip(topic))
    out = None
    for name, questions in V.INTERVIEW_QUESTIONS.items():
        value = F.array(*[F.lit(q) for q in questions])
        out = F.when(low == name, value) if out is None else out.when(low == name, value)
    return out.otherwise(F.array(*[F.lit(q) for q in V.INTERVIEW_QUESTIONS[V.INTERVIEW_DEFAULT]]))


def evaluation_code(topic: Column, question: Column, answer: Column) -> Column:
    """Number of the rule an answer meets; one past the rules: no function; two past: none.

    The topic picks a branch, the question (case-sensitive) a rule in it, the answer whether it hits.
    """
    low_topic, low = F.lower(T.strip(topic)), F.lower(answer)
    no_function, none = len(V.EVALUATION_RULES), len(V.EVALUATION_RULES) + 1
    branches: dict[str, list[int]] = {}
    for i, rule in enumerate(V.EVALUATION_RULES):
        branches.setdefault(rule[0], []).append(i)
    out = None
    for name, numbers in branches.items():
        inner = None
        for i in numbers:
            _topic, about, needles = V.EVALUATION_RULES[i][:3]
            met = F.when(T.contains_any(low, needles), F.lit(i))
            if about == "is_palindrome":
                met = met.when(~F.contains(low, F.lit("def ")), F.lit(no_function))
            met, hit = met.otherwise(F.lit(none)), F.contains(question, F.lit(about))
            inner = F.when(hit, met) if inner is None else inner.when(hit, met)
        inner, here = inner.otherwise(F.lit(none)), F.contains(low_topic, F.lit(name))
        out = F.when(here, inner) if out is None else out.when(here, inner)
    return out.otherwise(F.lit(none))


def evaluate_answer(topic: Column, question: Column, answer: Column) -> Column:
    """Struct ``score`` and five remarks (IV-2), looked up by the rule number."""
    default = V.EVALUATION_DEFAULT
    outcomes = [rule[3:] for rule in V.EVALUATION_RULES]
    outcomes.append((*V.EVALUATION_NO_FUNCTION, *default[len(V.EVALUATION_NO_FUNCTION) :]))
    outcomes.append(default)
    names = ["score", *V.EVALUATION_FIELDS]
    table = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in outcomes]
    )
    return F.get(table, evaluation_code(topic, question, answer))


def assess_sessions(evaluations: DataFrame, session: str, score: str, sessions: DataFrame | None = None) -> DataFrame:
    """Mean score per session to one decimal, a missing score counts 7, plus the fixed remarks (IV-3)."""
    default = V.EVALUATION_DEFAULT[0]
    summed = evaluations.groupBy(session).agg(
        F.sum(F.coalesce(F.col(score), F.lit(default)).cast("double")).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    if sessions is not None:
        summed = sessions.select(session).distinct().join(summed, session, "left")
    mean = F.coalesce("_sum", F.lit(0.0)) / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    return summed.select(
        session,
        half_even(mean, 1).alias("overall_score"),
        F.lit(V.ASSESSMENT_STRENGTHS).alias("strengths"),
        F.lit(V.ASSESSMENT_WEAKNESSES).alias("weaknesses"),
        F.lit(V.ASSESSMENT_SUGGESTIONS).alias("suggestions"),
    )


def score_band(score: Column) -> Column:
    """Strong, average or needs improvement (IV-4)."""
    out = None
    for least, label in V.SCORE_BANDS:
        if least is not None:
            hit = score >= least
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(V.SCORE_BANDS[-1][1]))


def transcript(questions: Column, answers: Column, scores: Column, feedback: Column) -> Column:
    """Numbered text of an interview; the shortest list decides the length (IV-5)."""
    n = F.least(F.size(questions), F.size(answers), F.size(scores))

    def entry(i: Column) -> Column:
        def at(c: Column) -> Column:
            return F.coalesce(F.try_element_at(c, i).cast("string"), F.lit("None"))

        return F.concat(
            F.lit("Q"), i.cast("string"), F.lit(": "), at(questions), F.lit("\nStudent Answer: "), at(answers),
            F.lit("\nScore: "), at(scores), F.lit("/10\nFeedback: "), at(feedback), F.lit("\n\n"),
        )

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), entry), "")).otherwise("")


def spoken_reply(message: Column) -> Column:
    """Struct ``reply, spoken_reply`` for a spoken question (VM-1)."""
    kind = T.first_match(F.lower(message), V.SPOKEN_RULES, "other")

    def text(pos: int) -> Column:
        other = F.format_string(V.SPOKEN_REPLIES["other"][pos], message)
        return (
            F.when(kind == "python", F.lit(V.SPOKEN_REPLIES["python"][pos]))
            .when(kind == "sql", F.lit(V.SPOKEN_REPLIES["sql"][pos]))
            .otherwise(other)
        )

    return F.struct(text(0).alias("reply"), text(1).alias("spoken_reply"))


# ------------------------------------------------------------------------------ model replies


def unfence(raw: Column) -> Column:
    """Reply without a leading code fence (with optional ``json`` tag) and a trailing fence (JS-1)."""
    text = T.strip(raw)
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\n", ""), r"\n```$", "")
    return F.when(F.startswith(text, F.lit("```")), T.strip(bare)).otherwise(text)


def parse_object(raw: Column, schema: t.StructType | str, required: list[str]) -> Column:
    """Parsed object when every required key is present, a null value included; else NULL (JS-2)."""
    text = unfence(raw)
    keys = F.json_object_keys(text)
    present = F.lit(True)
    for key in required:
        present = present & F.array_contains(keys, key)
    return F.when(F.coalesce(present, F.lit(False)), F.from_json(text, schema))


def parse_array(raw: Column, schema: t.ArrayType | str, first_key: str | None = None) -> Column:
    """Parsed non-empty array, with a key its first element must hold if named; else NULL (JS-2)."""
    text = unfence(raw)
    ok = F.json_array_length(text) > 0
    if first_key:
        ok = ok & F.array_contains(F.json_object_keys(F.get_json_object(text, "$[0]")), first_key)
    return F.when(F.coalesce(ok, F.lit(False)), F.from_json(text, schema))
