"""Sources and sinks (A1-A11), the nested form and the streaming ingest."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from suiteforge.fixtures import fx_outcomes
from suiteforge.schemas import from_nested, to_nested
from suiteforge.sources import io


def test_jsonl_roundtrip_and_dispatch(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text("\n".join(json.dumps({"id": f"a_{i}", "v": i}) for i in range(5)) + "\n")
    df = io.read_records(spark, str(p), "id string, v long")
    assert df.count() == 5
    arr = tmp_path / "items.json"
    arr.write_text(json.dumps([{"id": "x", "v": 1}, {"id": "y", "v": 2}]))
    assert io.read_records(spark, str(arr), "id string, v long").count() == 2
    with pytest.raises(ValueError):
        io.read_records(spark, str(tmp_path / "items.csv"))
    with pytest.raises(FileNotFoundError):
        io.read_jsonl(spark, str(tmp_path / "missing.jsonl"))


def test_write_append_skip(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(10).withColumnRenamed("id", "v")
    assert not io.should_skip(spark, out, overwrite=False)
    io.write_records(df, out)
    assert io.should_skip(spark, out, overwrite=False)
    assert not io.should_skip(spark, out, overwrite=True)
    io.append_records(df, out)
    assert spark.read.json(out).count() == 20
    io.write_records(df, out)  # overwrite
    assert spark.read.json(out).count() == 10


def test_round_layout(spark, tmp_path):
    base = str(tmp_path / "rounds")
    df = spark.range(4).withColumnRenamed("id", "v")
    io.write_round(df, base, 1)
    io.write_round(df.where("v < 2"), base, 2)
    assert io.read_round(spark, base, 2).count() == 4
    assert io.read_round(spark, base, 3).count() == 2
    with pytest.raises(ValueError):
        io.read_round(spark, base, 1)


def test_union_sources(spark, tmp_path):
    paths = {}
    for name in ("alpha", "beta"):
        p = tmp_path / f"{name}.jsonl"
        p.write_text("\n".join(json.dumps({"id": f"{name}_{i}"}) for i in range(3)))
        paths[name] = str(p)
    u = io.union_sources(spark, paths, "id string")
    assert sorted(r.source for r in u.collect()) == ["alpha"] * 3 + ["beta"] * 3


def test_report_single_file(spark, tmp_path):
    m = spark.createDataFrame([("mean", None, 0.5, 1), ("pass_at_k", "1", 0.25, 1)], "metric string, key string, value double, n long")
    out = str(tmp_path / "report")
    io.write_report(m, out)
    lines = spark.read.text(out).collect()
    assert len(lines) == 2


def test_nested_roundtrip(spark):
    o = fx_outcomes(spark, SF_SMALL).select("problem_id", "solution_id", "test_id", "pass", "reason")
    back = from_nested(to_nested(o))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, o.collect()))


def test_incremental_equals_batch(spark):
    import __spark_entry__ as E

    got = E.queries()["incremental_outcomes"](spark, SF_SMALL)
    want = fx_outcomes(spark, SF_SMALL).select("problem_id", "solution_id", "test_id", "pass", "reason")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_point_lookup_pushdown(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = io.point_lookup(df, "doc_id", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    assert F is not None


def test_report_metrics_table(spark, tmp_path):
    from suiteforge.fixtures import fx_outcome_details
    from suiteforge.operators import outcomes as oc
    from suiteforge.operators import stats as st

    d = fx_outcome_details(spark, SF_SMALL)
    rates = oc.solution_pass_rate(d)
    m = st.report_metrics(rates, d)
    got = {(r.metric, r.key): r.value for r in m.collect()}
    basic = st.stats_basic(rates).first()
    assert got[("basic", "total_solutions")] == basic.total_solutions
    assert got[("pass_at_k", "1/pass_at_k")] == st.pass_at_k(rates).where("k = 1").first().pass_at_k
    io.write_report(m, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(got)
