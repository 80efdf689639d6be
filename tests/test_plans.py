"""Plan guards: no cross joins anywhere, filters pushed to the scan in the flagship."""

import pytest

from places import SF_SMALL
from triplematch.plans.registry import load_all

QUERIES = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    plan = _plan(QUERIES[name].fn(spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_flagship_pushdown_and_pruning(spark):
    plan = _plan(QUERIES["dialogue_score"].fn(spark, SF_SMALL))
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
