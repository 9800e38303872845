"""The report from one pass over the outcomes."""

import pytest
from pyspark.sql import functions as F

from suiteforge.operators import outcomes as oc
from suiteforge.operators import stats as st
from suiteforge.session import cut_lineage

SCHEMA = "problem_id long, solution_id long, test_id long, pass boolean, reason string, error_message string, time_limit double"


def hot_details(spark):
    """One problem with over a third of all solutions; some reasons, messages and limits are missing."""
    sizes = spark.range(40).select(F.col("id").alias("problem_id"), F.when(F.col("id") == 0, 300).otherwise(12).alias("size"))
    cells = sizes.select("problem_id", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("s")).crossJoin(spark.range(7).withColumnRenamed("id", "test_id"))
    h = F.pmod(F.xxhash64("problem_id", "s", "test_id"), F.lit(100))
    ok = h < F.when(F.col("s") % 5 == 0, 100).otherwise(60)
    return cells.select(
        "problem_id", (F.col("s") * 3 + 1).cast("long").alias("solution_id"), "test_id", ok.alias("pass"),
        F.when(ok, F.lit("pass")).when(h > 90, F.lit("TimeOut 5s")).when(h > 80, F.lit("fail")).alias("reason"),
        F.when(~ok & (h > 70), F.concat(F.lit("message "), F.repeat((h % 9).cast("string"), 120))).when(~ok, F.lit("")).alias("error_message"),
        F.when(h % 3 > 0, (h % 3).cast("double")).alias("time_limit"),
    )


def as_dict(df):
    rows = df.collect()
    out = {(r.metric, r.key): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def test_report_equals_its_sections_at_any_partitioning(spark):
    d = cut_lineage(hot_details(spark))
    rates = oc.solution_pass_rate(d)
    got = [as_dict(st.report_metrics(details=d.repartition(n))) for n in (1, 200)]
    assert got[0] == got[1]
    for metric, section in (("reasons", st.stats_reasons(d)), ("errors", st.stats_errors(d)), ("time_limits", st.stats_time_limits(d))):
        for r in section.collect():
            assert got[0][(metric, f"{r[0]}/n")] == r.n and got[0][(metric, f"{r[0]}/pct")] == r.pct
    total = d.count()
    assert got[0][("tests", "total_tests")] == total and got[0][("tests", "passed")] == d.where("pass").count()
    assert got[0][("timeouts", "timeouts")] == d.where("lower(reason) like '%timeout%'").count()
    assert ("reasons", "unknown/n") in got[0]
    assert got[0][("tests_per_solution", "mean")] == 7 and got[0][("basic", "total_solutions")] == rates.count()


def test_cube_reads_the_outcomes_once_and_stays_small(spark, tmp_path):
    hot_details(spark).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    cube = st.outcome_cube(d)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    want = sum(d.select(*c).distinct().count() for c in (["problem_id", "solution_id"], ["reason"], ["time_limit"]))
    assert want < cube.count() <= want + 12  # and the distinct short messages
    report = st.report_metrics(details=d)
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()  # sections read the stored cube


def test_report_of_no_outcomes(spark):
    got = as_dict(st.report_metrics(details=spark.createDataFrame([], SCHEMA)))
    assert got[("basic", "total_solutions")] == 0 and got[("tests", "total_tests")] == 0
    assert not [k for k in got if k[0] in ("reasons", "errors", "time_limits", "pass_at_k")]


@pytest.mark.parametrize("partitions", [1, 50])
def test_pass_at_k_by_least_perfect_id(spark, partitions):
    rates = oc.solution_pass_rate(hot_details(spark)).repartition(partitions)
    plan = st.pass_at_k(rates)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    by_problem = {}
    for r in rates.collect():
        by_problem.setdefault(r.problem_id, []).append((r.solution_id, r.pass_rate))
    n = sum(map(len, by_problem.values())) // len(by_problem)
    ks = [k for k in (1, 2, 4, 8, 16, 32) if k < n] + [n]
    want = {k: round(sum(any(x == 1.0 for _, x in sorted(rows)[:k]) for rows in by_problem.values()) / len(by_problem), 6) for k in ks}
    assert {r.k: r.pass_at_k for r in st.pass_at_k(rates).collect()} == want
