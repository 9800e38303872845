"""One problem holding a third of all cells: salted and pruned paths give the plain results."""

from pyspark.sql import functions as F

from conftest import SF_MID
from suiteforge.fixtures import fx_raw_outcomes
from suiteforge.operators import outcomes as oc
from suiteforge.operators import select as sel


def _hot_outcomes(spark):
    raw = fx_raw_outcomes(spark, SF_MID)
    hot = F.col("problem_id") % 3 == 0
    remapped = raw.select(
        F.when(hot, F.lit(0)).otherwise(F.col("problem_id") + 1).cast("long").alias("problem_id"),
        F.when(hot, F.col("problem_id") * 16 + F.col("solution_id")).otherwise(F.col("solution_id")).cast("long").alias("solution_id"),
        "test_id",
        "pass",
    )
    return remapped


def test_hot_problem_paths_agree(spark, monkeypatch):
    raw = _hot_outcomes(spark)
    plain_grid = oc.complete_grid(raw, hot=False)
    salted_grid = oc.complete_grid(raw, chunk=16, hot=True)
    a = sorted(map(tuple, plain_grid.collect()))
    assert a == sorted(map(tuple, salted_grid.collect()))
    sizes = {r.problem_id: r.n for r in plain_grid.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[0] * 3 >= sum(sizes.values())  # the hot problem holds about a third of all cells

    grid = spark.createDataFrame(a, plain_grid.schema)
    monkeypatch.setattr(sel, "PAIR_CHUNK", 10**6)
    monkeypatch.setattr(sel, "PRUNE_MIN", 10**6)
    plain = (sorted(map(tuple, sel.diverse_five(grid).collect())), sorted(map(tuple, sel.similar_five(grid).collect())))
    monkeypatch.setattr(sel, "PAIR_CHUNK", 32)
    monkeypatch.setattr(sel, "PRUNE_MIN", 8)
    forced = (sorted(map(tuple, sel.diverse_five(grid).collect())), sorted(map(tuple, sel.similar_five(grid).collect())))
    assert plain == forced
    rates = oc.solution_pass_rate(grid)
    n_hot = sel.diverse_candidates(rates, sel.top_two(rates)).where("problem_id = 0").count()
    assert n_hot > 32  # the forced run salted the pair join and pruned the triple search
    assert any(r[0] == 0 for r in plain[0])
