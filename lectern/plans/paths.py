"""Queries for learning paths (LP-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.binding import once
from lectern.operators import paths as P
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table



def _grouped(items: str) -> str:
    """Four groups of the integer share of a list, at least one item each."""
    size = f"greatest(len({items}) // 4, 1)"
    return f"""list_transform(range(0, least(4, CAST(ceil(len({items}) / CAST({size} AS DOUBLE)) AS BIGINT))),
        lambda i: array_to_string({items}[i * {size} + 1 : i * {size} + {size}], ' '))"""


PARTS_SQL = f"""
lists AS (SELECT doc_id, source, lang,
    list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {S.strip('p')}), lambda p: p <> '') AS ps,
    {S.sentences('text')} AS ss, {S.words('text')} AS ws FROM documents),
pieces AS (SELECT doc_id, source, lang, CASE WHEN len(ps) >= 4 THEN ps[1:4] WHEN len(ss) >= 4 THEN {_grouped('ss')}
                  WHEN len(ws) > 0 THEN {_grouped('ws')} ELSE [] END AS parts FROM lists),
course_parts AS (SELECT doc_id, source, lang, CAST(week AS INTEGER) AS week,
                 {S.strip(f"regexp_replace(parts[week], '{S.BLANK}+', ' ', 'g')")} AS text
          FROM pieces, unnest(range(1, len(parts) + 1)) AS u(week))"""

_STOP = ", ".join(S.text(w) for w in V.TITLE_STOPWORDS)
PATHS_SQL = f"""{PARTS_SQL},
found AS (SELECT doc_id, week, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#-]*') AS ts FROM course_parts),
terms AS (SELECT doc_id, week, pos, lower(ts[pos]) AS term FROM found, unnest(range(1, len(ts) + 1)) u(pos)),
counted AS (SELECT doc_id, week, term, count(*) AS n, min(pos) AS first FROM terms
            WHERE length(term) > 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, week ORDER BY n DESC, first) AS r FROM counted),
titles AS (SELECT doc_id, week, string_agg(array_to_string(list_transform(
             regexp_extract_all(term, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), ''), ' & ' ORDER BY r) AS title
           FROM best WHERE r <= 3 GROUP BY doc_id, week),
course_paths AS (SELECT p.doc_id, p.source, p.lang, p.week,
            coalesce(title, upper(p.source[1]) || p.source[2:] || ' Core Concepts') AS topic,
            substr(p.text, 1, 320) AS details
          FROM course_parts p LEFT JOIN titles t USING (doc_id, week))"""


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


@query("LP-3 TXT-6", f"WITH {PARTS_SQL} SELECT doc_id, week, text FROM course_parts")
def course_parts(spark, sf_dir):
    """Every document in four parts."""
    return P.course_parts(_docs(spark, sf_dir), ["doc_id"])


@query("LP-4 LP-5", f"WITH {PATHS_SQL} SELECT doc_id, source, week, topic, details FROM course_paths")
def course_paths(spark, sf_dir):
    """A four-week path per document, titled by its commonest terms."""
    return P.course_path(_docs(spark, sf_dir), "doc_id")


KNOWN = {"en": ["heed", "tion"], "fr": ["vipa"], "de": [], "es": ["", "ción"]}
KNOWN_SQL = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(S.text(s) for s in v)}]" for k, v in KNOWN.items() if v
) + " ELSE [] END"


@query(
    "LP-6",
    f"""WITH {PATHS_SQL},
    flagged AS (SELECT *, len(list_filter({KNOWN_SQL}, lambda s: contains(lower(topic || ' ' || details), s))) > 0 AS known
                FROM course_paths),
    kept AS (SELECT *, count(*) FILTER (NOT known) OVER (PARTITION BY doc_id) AS fresh FROM flagged)
    SELECT doc_id, week, topic FROM kept WHERE fresh = 0 OR NOT known""",
)
def unknown_weeks(spark, sf_dir):
    """Weeks left after known skills are dropped; a path that would be empty is kept whole."""
    skills = None
    for lang, known in KNOWN.items():
        value = F.array(*[F.lit(s) for s in known]).cast("array<string>")
        hit = F.col("lang") == lang
        skills = F.when(hit, value) if skills is None else skills.when(hit, value)
    paths = P.course_path_array(_docs(spark, sf_dir))
    left = paths.select("doc_id", F.inline(P.drop_known(F.col("path"), skills)))
    return left.select("doc_id", "week", "topic")


# A course text per part: a numbered section, a roman one with plain lines, and one with odd numbering.
COURSE_TEXT = r"""concat(
  'Intro for ', p_brand, '\n',
  'Week ', p_size, ': ', p_name, '\n1. ', p_type, '\nstudy   the ', p_brand, '\nand more\n2. Price list\n',
  repeat(concat(p_name, ' '), 20), '\n',
  'WEEK iv - ', p_type, ' parts\n', p_name, '\n\n  ', p_brand, '  \nthird line\nfourth line\n',
  'week  x Review\n 3.  Two blanks\nskipped\n4. ', p_name, '\ntail 5. not a line\n7. Last ', p_partkey)"""
_LONG = "trim(repeat(p_name || ' ', 20))"
SECTIONS_SQL = f"""
sections AS (
  SELECT p_partkey, 0 AS week_pos, p_size AS week, p_name AS topic, 0 AS sub_pos, p_type AS name,
         'study the ' || p_brand || ' and more' AS details FROM part
  UNION ALL SELECT p_partkey, 0, p_size, p_name, 1, 'Price list',
         CASE WHEN length({_LONG}) > 180 THEN substr({_LONG}, 1, 177) || '...' ELSE {_LONG} END FROM part
  UNION ALL SELECT p_partkey, 1, 2, p_type || ' parts', 0, 'Topic 1', p_name FROM part
  UNION ALL SELECT p_partkey, 1, 2, p_type || ' parts', 1, 'Topic 2', p_brand FROM part
  UNION ALL SELECT p_partkey, 1, 2, p_type || ' parts', 2, 'Topic 3', 'third line' FROM part
  UNION ALL SELECT p_partkey, 2, 3, 'Review', 0, p_name, 'tail 5. not a line 7. Last ' || p_partkey FROM part
  UNION ALL SELECT p_partkey, 2, 3, 'Review', 1, 'Last ' || p_partkey, '' FROM part)"""


def part_courses(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", F.expr(COURSE_TEXT.replace("\n  ", " ")).alias("text")
    )


@query(
    "LP-7 LP-8 LP-9 LP-11",
    f"""WITH {SECTIONS_SQL} SELECT p_partkey, CAST(week_pos AS INTEGER) AS week_pos, CAST(week AS INTEGER) AS week, topic,
        CAST(sub_pos AS INTEGER) AS sub_pos, name, details, lower(CASE WHEN week_pos = 1 THEN details ELSE name END) AS tags
        FROM sections""",
)
def week_sections(spark, sf_dir):
    """Week headings and subtopics read out of a course text per part; the SQL states what must be found."""
    weeks = P.store_weeks(part_courses(spark, sf_dir), ["p_partkey"])
    rows = weeks.select("p_partkey", "week_pos", F.col("week").cast("int").alias("week"), "topic", F.posexplode(once(F.col("subtopics"))).alias("sub_pos", "s"))
    return rows.select(
        "p_partkey", "week_pos", "week", "topic", "sub_pos", F.col("s.name").alias("name"),
        F.col("s.details").alias("details"), F.array_join("s.tags", ",").alias("tags"),
    )


@query(
    "LP-10 LP-11",
    f"""SELECT CAST(i AS INTEGER) AS sub_pos, CAST(w AS INTEGER) AS week_pos, name, details FROM (VALUES
        {', '.join(f'({i}, {w}, {S.text(n)}, {S.text(d)})' for i, (w, n, d, _g) in enumerate(V.DEFAULT_SUBTOPICS))})
        AS v(i, w, name, details)
        WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, '(?i)week\\s+(\\d+|[ivxlcdm]+)\\s*[:\\-]?\\s*[^\\n]+'))""",
)
def store_plan(spark, sf_dir):
    """Subtopics of all documents, or the built-in plan as no document has week headings."""
    weeks = P.store_weeks(_docs(spark, sf_dir), ["doc_id"])
    plan = P.plan_or_default(P.flatten_subtopics(weeks, ["doc_id"]))
    return plan.select("sub_pos", "week_pos", "name", "details")


ENTRIES = [
    "Algorithms, Data Science", "JavaScript", " SQL , Excel", "Statistics, machine learning", "pandas,, numpy , Git",
    "Data Analytics", "a", "API, cloud, loops",
]
ENTRY_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {S.text(e)}" for i, e in enumerate(ENTRIES)) + " END"
_PLAN_VALUES = ", ".join(
    f"({i}, {S.text(n)}, {S.text(d)}, {S.text(chr(1).join([n, d, *g]).lower())})"
    for i, (_w, n, d, g) in enumerate(V.DEFAULT_SUBTOPICS)
)
_TRACK_VALUES = ", ".join(f"({S.text(t)}, {w}, {S.text(a)}, {S.text(b)})" for t, w, a, b in V.TRACK_WEEKS)
_FILLERS = ", ".join(
    f"({w + 1}, {S.text(V.FILLER_WEEKS[w % 3][0])}, {S.text(': '.join(V.FILLER_WEEKS[w % 3]))}, "
    f"{S.text(V.FINISHED_PLAN[w][0])}, {S.text(V.FINISHED_PLAN[w][1])})"
    for w in range(4)
)


@query(
    "LP-1 LP-2 LP-12 LP-13 LP-14 LP-15 LP-16",
    f"""WITH requests AS (
      SELECT c_custkey, c_nationkey % 4 + 1 AS n_weeks,
             list_filter(list_transform(string_split({ENTRY_SQL}, ','), lambda s: lower(trim(s))), lambda s: s <> '') AS skills
      FROM customer),
    routed AS (SELECT *, CASE c_custkey % 8 WHEN 1 THEN 'java_learning_path' WHEN 2 THEN 'python_sql_learning_path'
                         WHEN 5 THEN 'data_analysis_learning_path' END AS track FROM requests),
    plan AS (SELECT * FROM (VALUES {_PLAN_VALUES}) AS v(i, name, details, blob)),
    tracks AS (SELECT * FROM (VALUES {_TRACK_VALUES}) AS v(track, week, topic, details)),
    fillers AS (SELECT * FROM (VALUES {_FILLERS}) AS v(week, topic, details, done_topic, done_details)),
    alive AS (SELECT c_custkey, name, details, row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS pos
              FROM routed, plan WHERE track IS NULL AND len(list_filter(skills, lambda s: contains(blob, s))) = 0),
    weekly AS (SELECT c_custkey, pos % 4 + 1 AS week, string_agg(name, ' & ' ORDER BY pos) AS t,
                      string_agg(name || ': ' || details, '; ' ORDER BY pos) AS d FROM alive GROUP BY ALL),
    general AS (
      SELECT r.c_custkey, r.n_weeks, r.track, f.week,
        CASE WHEN r.c_custkey NOT IN (SELECT c_custkey FROM alive) THEN f.done_topic
             WHEN t IS NULL THEN f.topic WHEN length(t) > 65 THEN substr(t, 1, 62) || '...' ELSE t END AS topic,
        CASE WHEN r.c_custkey NOT IN (SELECT c_custkey FROM alive) THEN f.done_details ELSE coalesce(d, f.details) END AS details
      FROM (SELECT * FROM routed WHERE track IS NULL) r CROSS JOIN fillers f LEFT JOIN weekly w USING (c_custkey, week)
      UNION ALL SELECT r.c_custkey, r.n_weeks, r.track, t.week, t.topic, t.details FROM routed r JOIN tracks t USING (track))
    SELECT c_custkey, track, CAST(week AS INTEGER) AS week, topic, details FROM general
    WHERE week <= CASE WHEN c_custkey % 8 IN (1, 2) THEN 4 ELSE n_weeks END""",
)
def skill_paths(spark, sf_dir):
    """A learning path for every customer from the skills they enter."""
    requests = spread(table(spark, sf_dir, "customer")).select(
        "c_custkey", F.expr(ENTRY_SQL).alias("skills"), (F.col("c_nationkey") % 4 + 1).alias("weeks")
    )
    plan = P.plan_literal([(n, d, g) for _w, n, d, g in V.DEFAULT_SUBTOPICS])
    routed = P.skill_paths(requests, plan, "skills", "weeks")
    return routed.select("c_custkey", "track", F.inline(once(F.col("path"))))


COURSE_SQL = "CASE WHEN c_nationkey < 8 THEN NULL WHEN c_nationkey = 8 THEN '' ELSE ' Src' || (c_nationkey + 3) || ' ' END"


@query(
    "LP-2 LP-5 LP-6 LP-10 LP-12 LP-13 LP-14 LP-15 RET-12",
    f"""WITH {PATHS_SQL},
    requests AS (
      SELECT c_custkey, {COURSE_SQL} AS course_source,
             list_transform(string_split({ENTRY_SQL}, ','), lambda s: trim(s)) AS entered FROM customer),
    staged AS (SELECT *, list_transform(entered, lambda s: lower(s)) AS skills,
                 CASE c_custkey % 8 WHEN 1 THEN 'java_learning_path' WHEN 2 THEN 'python_sql_learning_path'
                      WHEN 5 THEN 'data_analysis_learning_path' END AS track FROM requests),
    docs AS (SELECT lower(source) AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    named AS (SELECT s.*, d.doc_id, CASE WHEN track IS NULL AND coalesce(course_source, '') <> '' THEN true ELSE false END AS asks
              FROM staged s LEFT JOIN docs d ON track IS NULL AND d.name = lower(trim(course_source))),
    tracks AS (SELECT * FROM (VALUES {_TRACK_VALUES}) AS v(track, week, topic, details)),
    plan AS (SELECT * FROM (VALUES {_PLAN_VALUES}) AS v(i, name, details, blob)),
    fillers AS (SELECT * FROM (VALUES {_FILLERS}) AS v(week, topic, details, done_topic, done_details)),
    flagged AS (SELECT n.c_custkey, p.source, p.week, p.topic, p.details,
                       len(list_filter(n.skills, lambda s: contains(lower(p.topic || ' ' || p.details), s))) > 0 AS known
                FROM named n JOIN course_paths p ON p.doc_id = n.doc_id WHERE asks),
    kept AS (SELECT *, count(*) FILTER (NOT known) OVER (PARTITION BY c_custkey) AS fresh FROM flagged),
    alive AS (SELECT c_custkey, name, details, row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS pos
              FROM named, plan WHERE track IS NULL AND NOT asks
                AND len(list_filter(skills, lambda s: s <> '' AND contains(blob, s))) = 0),
    weekly AS (SELECT c_custkey, pos % 4 + 1 AS week, string_agg(name, ' & ' ORDER BY pos) AS t,
                      string_agg(name || ': ' || details, '; ' ORDER BY pos) AS d FROM alive GROUP BY ALL)
    SELECT c_custkey, track AS path_source, CAST(NULL AS VARCHAR) AS error, CAST(t.week AS INTEGER) AS week, t.topic, t.details
      FROM named JOIN tracks t USING (track)
    UNION ALL SELECT c_custkey, source, NULL, CAST(week AS INTEGER), topic, details FROM kept WHERE fresh = 0 OR NOT known
    UNION ALL SELECT c_custkey, NULL, 'Selected course source was not found in the knowledge base.', NULL, NULL, NULL
      FROM named WHERE asks AND doc_id IS NULL
    UNION ALL SELECT n.c_custkey, NULL, NULL, CAST(f.week AS INTEGER),
        CASE WHEN n.c_custkey NOT IN (SELECT c_custkey FROM alive) THEN f.done_topic
             WHEN t IS NULL THEN f.topic WHEN length(t) > 65 THEN substr(t, 1, 62) || '...' ELSE t END,
        CASE WHEN n.c_custkey NOT IN (SELECT c_custkey FROM alive) THEN f.done_details ELSE coalesce(d, f.details) END
      FROM (SELECT * FROM named WHERE track IS NULL AND NOT asks) n CROSS JOIN fillers f LEFT JOIN weekly w USING (c_custkey, week)""",
)
def learning_paths(spark, sf_dir):
    """The whole path service for every customer: tracks, asked courses, unknown courses and general plans."""
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey", F.transform(F.split(F.expr(ENTRY_SQL), ","), F.trim).alias("skills"),
        F.expr(COURSE_SQL).alias("course_source"),
    )
    docs = _docs(spark, sf_dir).withColumn("position", F.col("doc_id"))
    made = P.learning_paths(spread(requests), docs)
    return made.select("c_custkey", "path_source", "error", F.inline_outer(once(F.col("path"))))


REQUESTS = [(1, ["Red", "steel "]), (2, [""]), (3, ["ECONOMY", "ring"]), (4, ["brand#1"]), (5, ["o"])]
_REQUEST_VALUES = ", ".join(
    f"({i}, [{', '.join(S.text(s.strip().lower()) for s in skills)}])" for i, skills in REQUESTS
)


@query(
    "LP-12 LP-13",
    f"""WITH requests AS (SELECT * FROM (VALUES {_REQUEST_VALUES}) AS v(request_id, skills)),
    alive AS (SELECT request_id, p_partkey, p_name AS name, row_number() OVER (PARTITION BY request_id ORDER BY p_partkey) - 1 AS position
              FROM requests, part WHERE len(list_filter(skills, lambda s: s <> '' AND (contains(lower(p_name), s)
                OR contains(lower(p_type), s) OR contains(lower(p_brand), s)))) = 0)
    SELECT request_id, p_partkey, name, position, CAST(position % 4 + 1 AS INTEGER) AS week FROM alive""",
)
def skill_anti_filter(spark, sf_dir):
    """Parts as a large store of subtopics, filtered and dealt to weeks for five requests."""
    store = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("details"), F.array("p_brand").alias("tags")
    )
    dealt = P.assign_weeks(store, REQUESTS, "p_partkey")
    return dealt.select("request_id", "p_partkey", "name", "position", "week")


@query(
    "LP-10 LP-12 LP-13 LP-14 LP-15",
    f"""WITH requests AS (
      SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN ['red'] WHEN 1 THEN ['', 'steel', 'ring'] WHEN 2 THEN ['ring', 'steel']
             WHEN 3 THEN ['brand#'] ELSE [] END AS skills FROM nation),
    alive AS (SELECT n_nationkey, p_name AS name, p_type AS details,
                     row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey, copy) - 1 AS pos
              FROM requests, part, range(8) AS c(copy) WHERE len(list_filter(skills, lambda s: s <> '' AND (contains(lower(p_name), s)
                OR contains(lower(p_type), s) OR contains(lower(p_brand), s)))) = 0),
    weekly AS (SELECT n_nationkey, pos % 4 + 1 AS week, string_agg(name, ' & ' ORDER BY pos) AS t,
                      string_agg(name || ': ' || details, '; ' ORDER BY pos) AS d FROM alive GROUP BY ALL),
    fillers AS (SELECT * FROM (VALUES {_FILLERS}) AS v(week, topic, details, done_topic, done_details))
    SELECT n_nationkey, CAST(f.week AS INTEGER) AS week,
        CASE WHEN n_nationkey NOT IN (SELECT n_nationkey FROM alive) THEN f.done_topic
             WHEN t IS NULL THEN f.topic WHEN length(t) > 65 THEN substr(t, 1, 62) || '...' ELSE t END AS topic,
        md5(CASE WHEN n_nationkey NOT IN (SELECT n_nationkey FROM alive) THEN f.done_details ELSE coalesce(d, f.details) END) AS details
    FROM requests CROSS JOIN fillers f LEFT JOIN weekly w USING (n_nationkey, week)""",
)
def store_paths(spark, sf_dir):
    """General plans from a store far beyond what travels inside a plan: eight copies of every part."""
    asked = F.expr(
        """CASE n_nationkey % 5 WHEN 0 THEN array('Red') WHEN 1 THEN array('', 'steel ', 'ring')
           WHEN 2 THEN array('ring', 'Steel') WHEN 3 THEN array('Brand#') ELSE array() END"""
    )
    requests = table(spark, sf_dir, "nation").select("n_nationkey", asked.alias("skills"), F.lit("").alias("course_source"))
    store = table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("copy"), F.col("p_name").alias("name"),
        F.col("p_type").alias("details"), F.array("p_brand").alias("tags"),
    )
    docs = table(spark, sf_dir, "documents").select("source", "text")
    made = P.learning_paths(requests, docs, store, order=("p_partkey", "copy"), digest=True)
    weeks = made.select("n_nationkey", F.inline(once(F.col("path"))))
    return weeks.select("n_nationkey", "week", "topic", "details")


@query(
    "LP-17",
    """SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS completed, count(*) AS total,
         round(count(*) FILTER (event_type IN ('purchase', 'signup')) / CAST(count(*) AS DOUBLE), 6) AS progress,
         CAST(floor(count(*) FILTER (event_type IN ('purchase', 'signup')) / CAST(count(*) AS DOUBLE) * 100) AS INTEGER) AS percent
       FROM events GROUP BY user_id""",
)
def completion_ratio(spark, sf_dir):
    """Share of completed steps per user."""
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("purchase", "signup").alias("done"))
    return P.completion(steps, "user_id", "done").withColumn("progress", F.round("progress", 6))
