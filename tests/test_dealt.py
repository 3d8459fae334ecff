"""Rows that take long to work out, in one small file, are worked out on all cores, and once."""

import pytest

from sedgeline.catalog import QUERIES
from sedgeline.plans.views import view

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["merged_lists", "name_agreement", "spore_measurements"])
def test_rows_of_one_file_are_many_tasks(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["answers", "members"])
def test_views_are_dealt(spark, name):
    assert view(spark, DATA, name, dealt=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_cells_are_parsed_once(spark):
    plan = QUERIES["host_cells"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "transform" in line for line in plan.splitlines())
    assert "Aggregate" in plan


def test_members_meet_by_shuffle(spark):
    assert "Broadcast" not in QUERIES["cluster_summaries"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_answers_are_judged_once(spark):
    plan = QUERIES["resolved_hosts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("levenshtein" in line for line in plan.splitlines()) == 1
