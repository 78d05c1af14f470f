"""Shape of the physical plans: what reaches the scan, what is cut before a shuffle, what must never appear."""

import re

import pytest

import __spark_entry__ as entry

TRAINED = {
    "forest_importance", "regression_scores", "classifier_scores", "boosted_importance", "shapley_sample",
    "row_drivers", "linear_attribution", "linear_drivers", "linear_importance", "tree_scores", "separable_scores",
    "explained_run",
    "level_importance", "tree_attribution", "tree_drivers",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in TRAINED and not re.match(r"op\d+_|pipeline$", n)])
def test_no_cross_join_and_no_row_python(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, bad
    # A window over everything would put all rows into one task.
    assert not re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Window", plan)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(entry.queries()["never_ordered"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderpriority,1-URGENT\)", plan)
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    best = plan_of(entry.queries()["group_avg"](spark, sf))
    assert "ReadSchema: struct<c_acctbal:double,c_mktsegment:string>" in best
    merged = plan_of(entry.queries()["merge_sorted"](spark, sf))
    assert merged.count("FileScan") == 1 and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate" in merged


@pytest.mark.parametrize("name", ["keyword_topk", "term_search", "cosine_topk"])
def test_top_k_is_cut_before_the_shuffle(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", plan)


@pytest.mark.parametrize("name", ["best_per_group", "group_mean", "categorical_profile", "session_scores", "grade_quiz"])
def test_groups_are_combined_before_the_shuffle(spark, sf, name):
    assert "partial_" in plan_of(entry.queries()[name](spark, sf))


@pytest.mark.parametrize("name", ["course_paths", "skill_paths", "code_reviews", "score_answers", "parse_replies"])
def test_row_rules_do_not_shuffle(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning")
