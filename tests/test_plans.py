"""Plans: what reaches the scan, and what is shuffled."""

from lectern.plans import QUERIES


def plan_of(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_filtered_top_k_pushes_its_filter_and_needs_no_shuffle(spark, data):
    plan = plan_of(spark, data, "r01_vector_topk_filtered")
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_scans_read_only_the_columns_they_need(spark, data):
    plan = plan_of(spark, data, "w06_share_of_total")
    assert "ReadSchema: struct<source:string>" in plan
    assert "text" not in plan_of(spark, data, "j13_anti_join")


def test_stated_queries_are_the_broadcast_side(spark, data):
    plan = plan_of(spark, data, "j17_batch_topk")
    assert "BroadcastNestedLoopJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_labels_are_made_in_one_partitioning(spark, data):
    plan = plan_of(spark, data, "a04_block_types")
    assert plan.count("Exchange hashpartitioning") <= 2


def test_chapter_semi_join_stays_above_its_limit(spark, data):
    plan = plan_of(spark, data, "r04_hierarchical")
    assert "LeftSemi" in plan and plan.count("TakeOrderedAndProject") >= 2


def test_images_are_ranked_before_they_meet_hits(spark, data):
    plan = plan_of(spark, data, "r10_image_links")
    assert "WindowGroupLimit" in plan and plan.rindex("Join") < plan.index("Window")
