"""S3 over several rounds with deterministic hooks: suites grow by the generated tests, one call per prompt."""

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from suiteforge.operators.evaluate import evaluate_grid
from suiteforge.operators.outcomes import P, S, T
from suiteforge.operators.select import diverse_five
from suiteforge.plans.evolve import CACHE_SCHEMA, evolve_round, generate_tests, run_rounds, selection_prompts
from suiteforge.plans.flow_queries import _stub_evaluator, _stub_generator, evolve_inputs


def counted(df, column="test_id"):
    return {r[P]: r.n for r in df.groupBy(P).agg(F.count(F.lit(1)).alias("n")).collect()}


def test_three_rounds_grow_suites(spark, tmp_path):
    o, tests, sols, problems = evolve_inputs(spark, SF_MID)
    calls = spark.sparkContext.accumulator(0)

    def generate(b):
        calls.add(len(b))
        return _stub_generator(b)

    base = str(tmp_path / "run")
    suite, outcomes = run_rounds(o, tests, sols, generate, _stub_evaluator, 3, base, problems)
    stored = spark.read.parquet(f"{base}/tests")
    sizes = [counted(stored.where(F.col("round") == r)) for r in (1, 2, 3)]
    per_round = {0: 4, 1: 4, 2: 2, 3: 2}  # two prompts a round: two tests each, one that was cut off, or the sentinel
    for before, after in zip(sizes, sizes[1:]):
        assert after and all(n == before[p] + per_round[p % 4] for p, n in after.items())
    assert counted(suite) == sizes[2]
    # the grid of the last round covers every solution x test of the grown suites
    n_sols = counted(sols)
    assert counted(outcomes) == {p: n * n_sols[p] for p, n in sizes[2].items()}
    # one call per prompt; only failures are asked again
    responses = spark.read.parquet(f"{base}/responses").where("round = 3")
    answered = responses.where(~F.col("response").startswith("ERROR:"))
    assert calls.value == responses.count() and answered.select("hash_id").distinct().count() == answered.count()
    assert spark.read.text(f"{base}/report").count() > 20
    # a rerun finds all rounds stored
    run_rounds(o, tests, sols, generate, _stub_evaluator, 3, base, problems)
    assert calls.value == responses.count()


def test_prompts_carry_the_task(spark):
    o, tests, sols, problems = evolve_inputs(spark, SF_SMALL)
    rows = selection_prompts(o, diverse_five(o), "diverse", problems, sols, tests).collect()
    assert rows
    for r in rows:
        assert r.prompt.startswith(f"Task {r.problem_id} (diverse)\nquestion {r.problem_id}\n")
        assert r.prompt.count("# program ") == r.prompt.count("def f(): return ") == r.prompt.count("    [") <= 5
        assert r.prompt.count("assert seed(") == len(set(r.prompt.split("assert seed(")[1:]))


def test_cached_prompts_are_not_sent_again(spark):
    o, tests, sols, problems = evolve_inputs(spark, SF_SMALL)
    prompts = selection_prompts(o, diverse_five(o), "diverse", problems, sols, tests)
    calls = spark.sparkContext.accumulator(0)

    def generate(b):
        calls.add(len(b))
        return _stub_generator(b)

    first, cache = generate_tests(prompts, spark.createDataFrame([], CACHE_SCHEMA), generate, "first")
    n = calls.value
    assert n == prompts.count() == cache.count()
    again, _ = generate_tests(prompts, cache, generate, "first")
    failed = cache.where(F.col("response").startswith("ERROR:")).count()
    assert calls.value == n + failed  # only failures are retried
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_resume_evaluates_only_what_is_missing(spark):
    o, tests, sols, problems = evolve_inputs(spark, SF_SMALL)
    whole = evaluate_grid(sols, tests, _stub_evaluator)
    seen = spark.sparkContext.accumulator(0)

    def evaluate(b):
        seen.add(1)
        return _stub_evaluator(b)

    done = whole.where(F.col(S) % 3 != 0)
    rest = evaluate_grid(sols, tests, evaluate, done=done)
    assert sorted(map(str, rest.select(P, S, T, "pass").collect())) == sorted(map(str, whole.select(P, S, T, "pass").collect()))
    assert seen.value >= sols.where(F.col(S) % 3 == 0).count()
    _, outcomes, _ = evolve_round(o, tests, sols, _stub_generator, evaluate, problems, done=whole)
    assert outcomes.count() > 0
