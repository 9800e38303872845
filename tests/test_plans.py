"""Plan checks: no Python outside the hooks; bounded exchange counts; pruning at the scan."""

import re

from conftest import SF_SMALL
from suiteforge.plans.catalog import QUERIES

HOOKS = {"evolve_round"}
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_hooks(spark):
    for name, q in QUERIES.items():
        if name in HOOKS or name == "incremental_outcomes":
            continue
        plan = _plan(q(spark, SF_SMALL))
        assert not any(n in plan for n in PY_NODES), name


def test_final_curation_exchanges(spark):
    plan = _plan(QUERIES["final_curation"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange", plan)) <= 12


def test_fixture_scan_prunes_columns(spark):
    from suiteforge.fixtures import fx_raw_outcomes

    plan = _plan(fx_raw_outcomes(spark, SF_SMALL))
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    cols = {c.split(":")[0] for c in m.group(1).split(",")}
    assert cols == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"}
