"""What the physical plans must and must not contain."""

import pytest

from watchfold.operators import baseline, bundles
from watchfold.plans.catalogue import QUERIES

STREAMING = {n for n in QUERIES if n.startswith("stream_")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_nested_loops_and_no_python(name, spark, testdata):
    plan = plan_of(QUERIES[name](spark, testdata))
    for banned in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython",
                   "MapInPandas", "BatchEvalPython"):
        assert banned not in plan, banned


@pytest.mark.parametrize("name", ["dedupe_first", "upsert_latest", "cooldown",
                                  "consolidate_by_rule"])
def test_first_per_key_is_limited_before_the_shuffle(name, spark, testdata, monkeypatch):
    monkeypatch.setattr(bundles, "cut_lineage", lambda df: df)  # so the plan shows all of it
    plan = plan_of(QUERIES[name](spark, testdata))
    partial = next(i for i, l in enumerate(plan.splitlines()) if "Partial" in l
                   and "WindowGroupLimit" in l)
    assert any("hashpartitioning" in l for l in plan.splitlines()[:partial])


def test_matching_does_not_shuffle(spark, testdata):
    plan = plan_of(QUERIES["kernel_rule_match"](spark, testdata))
    assert "hashpartitioning" not in plan


def test_columns_and_filters_reach_the_scan(spark, testdata):
    plan = plan_of(QUERIES["append_rate"](spark, testdata))
    assert "props" not in plan.split("ReadSchema")[-1]
    plan = plan_of(QUERIES["newest_n"](spark, testdata))
    assert "TakeOrderedAndProject" in plan and "EqualTo(event_type,error)" in plan


def test_context_join_has_equality_keys(spark, testdata):
    plan = plan_of(QUERIES["dns_context"](spark, testdata))
    assert "_bucket" in plan and "_salt" in plan


def test_baseline_join_is_an_anti_join(spark):
    df = spark.createDataFrame([("a", 1, "c")], "dedup_key string, event_ts_ns bigint, corr_id string")
    assert "LeftAnti" in plan_of(baseline.drop_benign(df, df))
