"""Plans: no cross joins, no row-at-a-time Python, pruned scans, bounded windows."""

from __future__ import annotations

import os
import re

import pytest

from dossier import plans

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")

NATIVE = [
    "best_documents", "tfidf_pairs", "resume_scores", "ranked_resumes", "embedding_text", "searchable_chunks",
    "window_chunks", "recent_messages", "conversation_texts", "usage_by_session", "routed_questions", "upload_batch",
    "topic_gate", "message_intents", "latest_versions", "first_free_versions",
]


def physical(spark, name):
    df = plans.QUERIES[name].build(spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = physical(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["nearest_by_distance", "search_results", "answered_questions", "nearest_in_cells"])
def test_vector_plans_hold_no_pair_table(spark, name):
    plan = physical(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    assert "WindowGroupLimit" in plan


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in physical(spark, "usage_by_session")
    plan = physical(spark, "judge_prompts")
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan


def test_one_shuffle_of_the_texts(spark):
    plan = physical(spark, "tfidf_pairs")
    scan_side = plan[: plan.index("BroadcastExchange")]
    assert scan_side.count("Exchange hashpartitioning(doc_id") == 1
