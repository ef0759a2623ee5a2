"""Plans: what is pushed down, what is not paired, what is limited early."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import action, actions, at
from tracewell.functions import predicates as p
from tracewell.operators import diffs, lookups, rollback
from tracewell.plans import registry
from tracewell.sources import facts
from test_storage import events

registry.load_all()
SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_query_pairs_everything(spark, name):
    plan = physical(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    # A one-row side (a total, the newest batch) is the only thing ever looped over.
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    facts.append_actions(events(spark, *[action(i, i * 3600, 1 + i % 40, x=i) for i in range(200)]), root)
    return root


def test_filters_and_columns_reach_the_scan(spark, stored):
    flt = p.ActionFilter(since=at(3600), x=5, z=0, radius=3, types=("block",), rolled_back=None)
    plan = physical(flt.apply(facts.facts(spark, stored)).select("id", "ts"))
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    for part in ("GreaterThanOrEqual(ts", "GreaterThanOrEqual(x,2)", "LessThanOrEqual(x,8)", "In(type"):
        assert part in pushed
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "target" not in schema and "entity_nbt" not in schema


def test_newest_rows_are_limited_before_the_shuffle(spark, stored):
    for df in (
        rollback.newest_per_position(facts.facts(spark, stored).withColumn("world_key", F.lit("w"))),
        lookups.user_last_n(facts.facts(spark, stored), 5),
    ):
        assert "WindowGroupLimit" in physical(df).split("Exchange hashpartitioning")[-1]


def test_pages_are_top_k(spark, stored):
    assert "TakeOrderedAndProject" in physical(lookups.page_newest(facts.facts(spark, stored), 10, 20))


def test_segment_windows_never_partition_by_key_alone(spark):
    rows = actions(spark, action(1, 0, 26)).withColumn("block", F.lit("m:x"))
    plan = physical(diffs.classify_block_changes(rows, timedelta(hours=1)))
    assert "_seg" in plan
