"""What the physical plans must and must not hold."""

import re

import pytest

from lorekeep.plans import catalog


def plan(spark, sf, name):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", "content_sha tier_of_url titles_and_slugs path_styles conventions mojibake_repair facts_capitals facts_stated coverage faithfulness shingle_counts backend_hits admissibility feed_evidence".split())
def test_row_wise_queries_neither_shuffle_nor_leave_the_jvm(spark, sf, name):
    p = plan(spark, sf, name).split("== Physical Plan ==")[1]
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p and "Pandas" not in p


@pytest.mark.parametrize("name", "audit_findings gate_outcomes artifact_build normalized_texts frontmatter_fields".split())
def test_headers_cost_no_shuffle(spark, sf, name):
    p = plan(spark, sf, name).split("== Physical Plan ==")[1]
    assert "Exchange" not in p and "ArrowEvalPython" in p


@pytest.mark.parametrize("name,columns", [("content_sha", {"doc_id", "text"}), ("tier_of_url", {"page_id", "url"}), ("duplicate_summary", {"text"}), ("hot_top10", {"vec_id", "embedding"}), ("seen_shas", {"event_id", "event_type", "user_id"})])
def test_scans_read_needed_columns_only(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>\s", plan(spark, sf, name) + " ")
    assert read and all({c.split(":")[0] for c in re.split(r",(?![^<]*>)", r)} <= columns for r in read)


@pytest.mark.parametrize("name", "keeper_rank exact_duplicates cleanup_plan resolve_best delta_unseen cold_bm25 two_tier_recall near_dup_keepers".split())
def test_nothing_is_compared_with_everything(spark, sf, name):
    p = plan(spark, sf, name).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in p
    # The only nested loop is with one row of statistics.
    assert ("BroadcastNestedLoopJoin" in p) <= (name in ("cold_bm25", "two_tier_recall"))


def test_first_of_each_hash_is_a_partial_aggregate(spark, sf):
    p = plan(spark, sf, "delta_unseen").split("== Physical Plan ==")[1]
    assert "partial_min" in p and "Window" not in p and "PushedFilters" in p
