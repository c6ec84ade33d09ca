"""What the plans must look like to hold on large tables."""

import re

import pytest

import __spark_entry__ as entry
from tidemill.operators import bodies, rules
from tidemill.sources import archive
from tidemill.sources.star import read_table

QUERIES = {name: build for plan in (entry.SALES, entry.PAGES, entry.MAIL) for name, build in plan.queries.items()}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_pairs(name, spark, small):
    plan = physical(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_best_sellers_read_and_keep_little(spark, small):
    plan = physical(QUERIES["top_products"](spark, small))
    assert "TakeOrderedAndProject" in plan
    schemas = dict.fromkeys(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert {tuple(column.split(":")[0] for column in schema.split(",")) for schema in schemas} == {
        ("l_orderkey", "l_partkey", "l_quantity", "l_linestatus"),
        ("o_orderkey", "o_orderstatus"),
        ("p_partkey", "p_brand"),
    }


def test_rules_are_one_narrow_jvm_pass(spark, small):
    plan = physical(rules.classify(archive.documents(spark, small)))
    assert "Exchange" not in plan and "Python" not in plan and plan.count("FileScan") == 1


def test_part_trees_take_one_scan_and_one_shuffle(spark, small):
    parts = archive.document_parts(read_table(spark, small, "documents"))
    plan = physical(bodies.select_body(parts))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["thread_context", "turn_history", "context_of_new_messages", "delivered_qty"])
def test_building_runs_no_job(name, spark, small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", name)
    QUERIES[name](spark, small)
    # Reading a table's schema is a job of one task.
    stages = [tracker.getJobInfo(job).stageIds for job in tracker.getJobIdsForGroup("building")]
    assert all(len(ids) == 1 and tracker.getStageInfo(ids[0]).numTasks == 1 for ids in stages)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_label_statistics_shuffle_counts_only(spark, small):
    from tidemill.operators.search import label_stats

    plan = physical(label_stats(archive.conversations(spark, small)))
    assert "Expand" in plan or "Generate" in plan
    assert plan.count("Exchange SinglePartition") == 1 and plan.count("FileScan") == 1


def test_date_filters_reach_the_scan(spark, small):
    plan = physical(QUERIES["delivered_by_family"](spark, small))
    assert "o_orderdate" in re.search(r"ReadSchema: struct<o_orderkey[^>]*>", plan).group()


@pytest.mark.parametrize("name,scans", [("applied_labels", 2), ("merged_labels", 2), ("run_stats", 8), ("quarantined_events", 1)])
def test_scans_are_few(name, scans, spark, small):
    assert physical(QUERIES[name](spark, small)).count("FileScan") <= scans
