"""Queries for chart data and column profiles (VIZ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import profiling as P
from lectern.plans.registry import query, table
from lectern.plans.relational import PAIRS_SQL, PRICED, PRICED_SQL, priced

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABELS = ["l_returnflag", "l_linestatus"]

# Line items with gaps: every eleventh price and every seventh flag is missing, and every thirteenth price is NaN.
GAPPED = {
    "l_orderkey": "l_orderkey",
    "l_quantity": "l_quantity",
    "l_extendedprice": "CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 THEN l_extendedprice END",
    "l_discount": "l_discount",
    "l_tax": "l_tax",
    "l_returnflag": "CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END",
    "l_linestatus": "l_linestatus",
}
GAPPED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in GAPPED.items()) + " FROM lineitem"


def gapped(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in GAPPED.items()])
    price = F.when(F.col("l_orderkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return rows.withColumn("l_extendedprice", price)


@query(
    "VIZ-1 VIZ-2 VIZ-3",
    f"""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS l_extendedprice FROM ({GAPPED_SQL})
        WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag""",
)
def group_mean(spark, sf_dir):
    bars = P.chart_data(gapped(spark, sf_dir), "l_returnflag", "l_extendedprice", "bar")
    return bars.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "VIZ-4",
    f"""SELECT l_quantity, l_returnflag, count(*) AS "Count" FROM ({GAPPED_SQL})
        WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1, 2""",
)
def group_count(spark, sf_dir):
    return P.chart_data(gapped(spark, sf_dir), "l_quantity", "l_returnflag", "line")


@query(
    "VIZ-1 VIZ-5",
    f"""SELECT l_quantity, l_extendedprice FROM ({GAPPED_SQL})
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""",
)
def scatter_rows(spark, sf_dir):
    return P.chart_data(gapped(spark, sf_dir), "l_quantity", "l_extendedprice", "scatter")


@query(
    "VIZ-6",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max,
            round(stddev_samp({c}), 4) AS std FROM ({GAPPED_SQL})"""
        for c in NUMBERS
    ),
)
def numeric_profile(spark, sf_dir):
    out = P.numeric_profile(gapped(spark, sf_dir), NUMBERS)
    return out.select("column", F.round("mean", 4).alias("mean"), "min", "max", F.round("std", 4).alias("std"))


def _categorical_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(v) AS unique_count,
            coalesce(first(v ORDER BY n DESC, v) FILTER (v IS NOT NULL), 'N/A') AS most_common,
            CAST(coalesce(max(n), 0) AS BIGINT) AS most_common_frequency
            FROM (SELECT CAST({c} AS VARCHAR) AS v, count({c}) AS n FROM {source} GROUP BY 1)"""
        for c in columns
    )


@query("VIZ-7", _categorical_sql(f"({GAPPED_SQL})", LABELS))
def categorical_profile(spark, sf_dir):
    return P.categorical_profile(gapped(spark, sf_dir), LABELS)


@query("VIZ-7", _categorical_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def order_profile(spark, sf_dir):
    return P.categorical_profile(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


CHARTS = [
    ("Scatter Plot 🎯", "l_quantity", "l_extendedprice"),
    ("Bar Chart 📊", "l_returnflag", "l_extendedprice"),
    ("Line Chart 📈", "l_discount", "l_linestatus"),
    ("Area Chart 🗺️", "l_linestatus", "l_returnflag"),
]
CHART_VALUES = ", ".join(f"('{k}', '{x}', '{y}')" for k, x, y in CHARTS)


def _sql_printf(template: str, *args: str) -> str:
    pieces = template.replace("%d", "%s").split("%s")
    out = [f"'{pieces[0]}'".replace("\n", "' || chr(10) || '")]
    for a, p in zip(args, pieces[1:], strict=True):
        out += [f"CAST({a} AS VARCHAR)", "'" + p.replace("\n", "' || chr(10) || '") + "'"]
    return " || ".join(out)


_MEANS = " UNION ALL ".join(
    f"SELECT '{c}' AS c, avg({c}) AS mean, CAST(NULL AS BIGINT) AS uniq FROM ({GAPPED_SQL})" for c in NUMBERS
)
_UNIQUES = " UNION ALL ".join(
    f"SELECT '{c}' AS c, NULL AS mean, count(DISTINCT {c}) AS uniq FROM ({GAPPED_SQL})" for c in LABELS
)


@query(
    "VIZ-8",
    f"""WITH stats AS ({_MEANS} UNION ALL {_UNIQUES}),
    charts AS (SELECT * FROM (VALUES {CHART_VALUES}) AS v(chart, x, y))
    SELECT chart, x, y,
      {_sql_printf(P.DESCRIBE_HEAD, 'chart', 'x', 'y')}
      || CASE WHEN a.mean IS NOT NULL AND b.mean IS NOT NULL
           THEN {_sql_printf(P.DESCRIBE_MEANS, 'x', "format('{:.2f}', a.mean)", 'y', "format('{:.2f}', b.mean)")}
           ELSE coalesce({_sql_printf(P.DESCRIBE_UNIQUE, 'x', 'a.uniq')}, '')
             || coalesce({_sql_printf(P.DESCRIBE_UNIQUE, 'y', 'b.uniq')}, '') END
      || {_sql_printf(P.DESCRIBE_TAIL, 'y', 'x')} AS description
    FROM charts JOIN stats a ON a.c = x JOIN stats b ON b.c = y""",
)
def chart_descriptions(spark, sf_dir):
    """One description per chart, from the profile of the whole table."""
    stats = P.profile(gapped(spark, sf_dir), NUMBERS, LABELS).select("column", "mean", "unique_count")
    charts = spark.createDataFrame(CHARTS, "chart string, x string, y string")
    of_x = stats.select(F.col("column").alias("x"), F.col("mean").alias("xm"), F.col("unique_count").alias("xu"))
    of_y = stats.select(F.col("column").alias("y"), F.col("mean").alias("ym"), F.col("unique_count").alias("yu"))
    text = P.describe(*[F.col(c) for c in ("chart", "x", "y", "xm", "ym", "xu", "yu")])
    return charts.join(of_x, "x").join(of_y, "y").select("chart", "x", "y", text.alias("description"))


_NAMES = list(PRICED)


@query(
    "VIZ-9",
    f"""WITH priced AS ({PRICED_SQL}), pairs AS ({PAIRS_SQL})
    SELECT feature_a, feature_b, round(correlation, 6) AS correlation FROM pairs
    UNION ALL SELECT feature_b, feature_a, round(correlation, 6) FROM pairs
    UNION ALL SELECT n, n, 1.0 FROM (VALUES {', '.join(f"('{n}')" for n in _NAMES)}) AS v(n)""",
)
def correlation_matrix(spark, sf_dir):
    out = P.correlation_matrix(priced(spark, sf_dir), _NAMES)
    return out.withColumn("correlation", F.round("correlation", 6))


@query(
    "VIZ-10",
    f"""WITH t AS (SELECT l_returnflag, l_extendedprice AS v FROM ({GAPPED_SQL})
                   WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL),
    q AS (SELECT l_returnflag, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.75) AS q3 FROM t GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
    SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
           round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence,
           min(v) AS min, max(v) AS max, count(*) FILTER (v < lower_fence OR v > upper_fence) AS outliers
    FROM t JOIN f USING (l_returnflag) GROUP BY ALL""",
)
def box_summary(spark, sf_dir):
    out = P.box_summary(gapped(spark, sf_dir), "l_returnflag", "l_extendedprice")
    rounded = [F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")]
    return out.select("l_returnflag", *rounded, "min", "max", "outliers")


@query(
    "VIZ-11",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / 10), 6) AS left_edge,
            round(lo + bin * ((hi - lo) / 10), 6) AS right_edge, count(*) AS n
            FROM (SELECT lo, hi, least(floor(({c} - lo) / ((hi - lo) / 10)) + 1, 10) AS bin
                  FROM ({GAPPED_SQL}), (SELECT min({c}) AS lo, max({c}) AS hi FROM ({GAPPED_SQL}))
                  WHERE {c} IS NOT NULL) GROUP BY lo, hi, bin"""
        for c in NUMBERS
    ),
)
def histogram(spark, sf_dir):
    out = P.histogram(gapped(spark, sf_dir), NUMBERS)
    return out.select(
        "column", "bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n"
    )


_MATRIX = NUMBERS[:3]


@query(
    "VIZ-12",
    " UNION ALL ".join(
        f"""SELECT l_orderkey, '{a}' AS x_column, '{b}' AS y_column, {a} AS x, {b} AS y FROM ({GAPPED_SQL})
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for i, a in enumerate(_MATRIX)
        for b in _MATRIX[i + 1 :]
    ),
)
def scatter_matrix(spark, sf_dir):
    return P.scatter_matrix(gapped(spark, sf_dir), _MATRIX, ["l_orderkey"])


def _grid_bin(c: str) -> str:
    return f"least(floor(({c} - min({c}) OVER ()) / ((max({c}) OVER () - min({c}) OVER ()) / 20)) + 1, 20)"


@query(
    "VIZ-5 VIZ-12",
    f"WITH cells AS (SELECT {', '.join(f'CAST({_grid_bin(c)} AS INTEGER) AS {c}' for c in _MATRIX)} FROM ({GAPPED_SQL})) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS x_column, '{b}' AS y_column, {a} AS x_bin, {b} AS y_bin, count(*) AS n FROM cells
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"""
        for i, a in enumerate(_MATRIX)
        for b in _MATRIX[i + 1 :]
    ),
)
def scatter_grid(spark, sf_dir):
    """The scatter matrix as counts on a grid, which stays small whatever the table."""
    return P.scatter_grid(gapped(spark, sf_dir), _MATRIX, 20)
