"""The text queries that SQL can express agree with it on the driver's sf0.01 tables; native ones run no Python."""

import pytest
from conftest import SF01, plan_text
from parity import compare, duck

from scoreline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, key):
    res = compare(spark, duck(SF01), key, QUERIES[key], ORACLE_SQL[key], SF01)
    assert res.get("match"), res


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_joins_and_no_row_by_row_python(spark, key):
    plan = plan_text(QUERIES[key](spark, "/root/testdata/sf0.001"))
    native = key.split("_")[0] in ("op3", "op6", "op9")
    for op in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "PythonUDF"] + ["MapInArrow", "ArrowEvalPython"] * native:
        assert op not in plan, f"{key}: {op} in plan"
