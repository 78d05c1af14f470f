"""Queries for the relational tasks (TB-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import relational as L
from lectern.plans import sql as S
from lectern.plans.registry import query, spread, table


@query(
    "TB-1",
    """SELECT c.c_custkey, c.c_name FROM customer c
       LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') o
         ON o.o_custkey = c.c_custkey
       WHERE o.o_orderkey IS NULL""",
)
def never_ordered(spark, sf_dir):
    """Customers without a finished urgent order."""
    orders = table(spark, sf_dir, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return L.never_ordered(customers, orders, "c_custkey", "o_custkey")


@query(
    "TB-2",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
         FROM orders) WHERE rn = 1""",
)
def best_per_group(spark, sf_dir):
    """Each customer's largest order."""
    keep = ["o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"]
    best = L.best_per_group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], keep)
    return best.orderBy("o_custkey")


STREAK_SQL = """
days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
marked AS (SELECT *, CASE WHEN lag(d) OVER (PARTITION BY user_id ORDER BY d) = d - 1 THEN 0 ELSE 1 END AS fresh FROM days),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY d) AS run FROM marked),
streaks AS (SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM runs GROUP BY user_id, run)"""


@query(
    "TB-3",
    f"""WITH {STREAK_SQL} SELECT user_id, strftime(first_day, '%Y-%m-%d') AS first_day,
        strftime(last_day, '%Y-%m-%d') AS last_day, days FROM streaks""",
)
def login_streaks(spark, sf_dir):
    runs = L.streaks(table(spark, sf_dir, "events"), "user_id", "ts")
    return runs.select(
        "user_id",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
        "days",
    )


@query("TB-3", f"WITH {STREAK_SQL} SELECT DISTINCT user_id FROM streaks WHERE days >= 3")
def active_users(spark, sf_dir):
    return L.active_users(table(spark, sf_dir, "events"), "user_id", "ts")


@query(
    "TB-6",
    """WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders),
    c AS (SELECT o_custkey, min(m) AS c FROM m GROUP BY 1),
    sizes AS (SELECT c, count(*) AS size FROM c GROUP BY 1),
    cells AS (SELECT c.c, CAST(date_diff('month', c.c, m.m) AS INTEGER) AS month_offset,
                     count(DISTINCT m.o_custkey) AS users FROM m JOIN c USING (o_custkey) GROUP BY 1, 2)
    SELECT strftime(c, '%Y-%m') AS cohort, month_offset, users, round(users * 100.0 / CAST(size AS DOUBLE), 4) AS retention_pct
    FROM cells JOIN sizes USING (c)""",
)
def cohort_retention(spark, sf_dir):
    long = L.cohort_retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
    return long.withColumn("retention_pct", F.round("retention_pct", 4))


PRICED = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discounted": "l_extendedprice * (1 - l_discount)",
    "charged": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "tax": "l_tax",
}
# Every seventeenth quantity is NaN, which counts as missing.
PRICED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PRICED.items()) + " FROM lineitem"
PRICED_SQL = PRICED_SQL.replace("l_quantity AS", "CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS")
PRICED_PAIRS = [(a, b) for i, a in enumerate(PRICED) for b in list(PRICED)[i + 1 :]]
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM priced" for a, b in PRICED_PAIRS
)


def priced(spark, sf_dir):
    """Line items with derived price columns, which do correlate."""
    rows = table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_orderkey") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rows.withColumn("l_quantity", quantity).select(*[F.expr(e).alias(n) for n, e in PRICED.items()])


@query(
    "TB-5",
    f"""WITH priced AS ({PRICED_SQL}), pairs AS ({PAIRS_SQL})
        SELECT feature_a, feature_b, round(correlation, 6) AS correlation FROM pairs WHERE abs(correlation) > 0.9""",
)
def correlated_pairs(spark, sf_dir):
    pairs = L.correlated_pairs(priced(spark, sf_dir), list(PRICED), 0.9)
    return pairs.withColumn("correlation", F.round("correlation", 6))


@query(
    "TB-10",
    """SELECT (SELECT DISTINCT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 1) AS second_highest""",
)
def second_highest(spark, sf_dir):
    return L.second_highest(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "TB-11",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O'
       GROUP BY o_custkey HAVING sum(o_totalprice) > 500000""",
)
def having_filter(spark, sf_dir):
    groups = L.filtered_groups(
        table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", "o_custkey",
        F.sum("o_totalprice").alias("total"), F.col("total") > 500000,
    )
    return groups.withColumn("total", F.round("total", 2))


@query(
    "TB-12",
    "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS average FROM customer GROUP BY c_mktsegment",
)
def group_avg(spark, sf_dir):
    out = L.group_average(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "average")
    return out.withColumn("average", F.round("average", 4))


GAPPED_SQL = (
    "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_acctbal END AS weight FROM customer"
)


@query(
    "TB-4",
    f"""WITH gapped AS ({GAPPED_SQL})
        SELECT c_custkey, round(coalesce(weight, (SELECT quantile_cont(weight, 0.5) FROM gapped)), 4) AS weight FROM gapped""",
)
def median_impute(spark, sf_dir):
    """Balances with every fifth one missing and every seventh NaN, filled with the median of the rest."""
    weight = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit(float("nan")))
    gapped = table(spark, sf_dir, "customer").select("c_custkey", weight.otherwise(F.col("c_acctbal")).alias("weight"))
    return L.impute_median(gapped, "weight").withColumn("weight", F.round("weight", 4))


@query(
    "TB-7",
    f"SELECT doc_id, array_to_string(list_reverse({S.words('text')}), ' ') AS reversed FROM documents",
)
def reverse_words(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", L.reverse_words(F.col("text")).alias("reversed"))


@query(
    "TB-8",
    """SELECT doc_id, CAST(len(s) AS INTEGER) AS n_starts, coalesce(array_to_string(s, ','), '') AS starts FROM (
         SELECT doc_id, list_filter(range(0, greatest(length(text) - 2, 0)),
                lambda i: substr(text, i + 1, 3) IN ('the', 'teh', 'het', 'hte', 'eth', 'eht')) AS s FROM documents)""",
)
def anagram_starts(spark, sf_dir):
    """Where any ordering of "the" starts in each document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", L.anagram_starts(F.col("text"), F.lit("the")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n_starts"), F.array_join("s", ",").alias("starts"))


@query(
    "TB-14",
    f"""SELECT doc_id, count(*) AS n_words, count(*) FILTER (lower(w) = reverse(lower(w))) AS n_palindromes
        FROM (SELECT doc_id, unnest({S.words('text')}) AS w FROM documents) GROUP BY doc_id""",
)
def palindrome_words(spark, sf_dir):
    """Palindromes among each document's words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(L.is_palindrome(F.col("w"))).alias("n_palindromes")
    )


@query(
    "TB-9",
    """SELECT o_totalprice, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""",
)
def merge_sorted(spark, sf_dir):
    """The yearly order sets, orders without a date among them, merged into one ascending set in one scan."""
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", F.year("o_orderdate").alias("y"))
    return L.merge_sorted([orders], "o_totalprice", ["o_orderkey"])


@query(
    "TB-13",
    """WITH p AS (SELECT quality AS label, CAST(n_chars >= 500 AS INTEGER) AS said
                  FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT DISTINCT label AS class FROM p UNION SELECT DISTINCT said FROM p),
    m AS (SELECT class, count(*) FILTER (label = class) AS actual, count(*) FILTER (said = class) AS said,
                 count(*) FILTER (label = class AND said = class) AS hit FROM c, p GROUP BY class),
    r AS (SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE hit / CAST(said AS DOUBLE) END AS p,
                 CASE WHEN actual = 0 THEN 0.0 ELSE hit / CAST(actual AS DOUBLE) END AS r FROM m)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
           round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, actual AS support FROM r""",
)
def confusion_metrics(spark, sf_dir):
    """How well text length predicts the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("said"))
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id")
    out = L.class_metrics(judged, "quality", "said")
    return out.select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )
