"""Scale rules as plan assertions (physical plans at sf0.001)."""

import pytest

from tests.conftest import SF_SMALL
from tidepool.plans.catalog import QUERIES

BATCH_KEYS = sorted(k for k in QUERIES if not k.startswith("stream_"))
PYTHON_OK = {"normalize_unicode"}


def plan_of(spark, key):
    return QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_no_nested_loops_and_python_only_for_nfkd(spark, key):
    plan = plan_of(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    uses_python = "ArrowEvalPython" in plan or "BatchEvalPython" in plan
    assert uses_python == (key in PYTHON_OK)


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark, "triage_queue")
    assert "PushedFilters: [IsNotNull(lang), IsNotNull(doc_id), EqualTo(lang,en)]" in plan


def test_history_side_reads_few_columns(spark):
    # the anti-join against timeline history reads url/page_id, never all columns
    plan = plan_of(spark, "anti_seen_news")
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert any("[page_id" in s and ",url" in s and "html" not in s for s in scans)


def final_plan(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


# scans and exchanges of the plans that ran; a sync reads both sides once to count and once
# more for their own rows, which stay as they are (the second count is the first's exchange)
@pytest.mark.parametrize("key,scans,exchanges", [
    ("term_frequencies", 1, 0), ("sync_tables", 4, 2), ("post_gate", 1, 0), ("duplicate_keys", 1, 1)])
def test_scan_and_exchange_counts(spark, key, scans, exchanges):
    plan = final_plan(spark, key)
    assert plan.count("FileScan parquet") <= scans
    assert plan.count("Exchange hashpartitioning") <= exchanges
