"""The two user hooks: generator (J7, with the cache) and evaluator."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_SMALL
from suiteforge.fixtures import fx_problems
from suiteforge.functions import text as tx
from suiteforge.operators import cache as ca
from suiteforge.operators import evaluate as ev
from suiteforge.operators import outcomes as oc


try:  # the test module's hooks travel to Python workers by value
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass


def _items(spark):
    p = fx_problems(spark, SF_SMALL)
    prompt = tx.problem_text("question", "starter_code")
    return p.select("id", prompt.alias("prompt"), F.sha2(prompt, 256).alias("hash_id"))


def _gen(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"hash_id": b["hash_id"], "response": "answer:" + b["prompt"].str[:10]})


def test_generate_resume_twice_equals_once(spark):
    items = _items(spark)
    empty = spark.createDataFrame([], "hash_id string, response string, seq long")
    first = ca.generate_with(items, empty, _gen)
    cache1 = spark.createDataFrame(first.collect(), first.schema)  # the appended cache table (small test data)
    assert cache1.count() == items.select("hash_id").distinct().count()  # one call per distinct prompt
    second = ca.generate_with(items, cache1, _gen)
    assert second.count() == 0  # nothing pending on the second run
    attached = ca.attach_cached(items, cache1)
    assert attached.where(~F.col("cached")).count() == 0


def test_errors_are_retried(spark):
    items = _items(spark).limit(3)
    rows = [(r.hash_id, "ERROR: Timeout after 3 attempts", 1) for r in items.collect()]
    cache = spark.createDataFrame(rows, "hash_id string, response string, seq long")
    assert ca.pending(items, cache).count() == 3
    assert ca.pending(items, cache, retry_errors=False).count() == 0


def _evaluator(b: pd.DataFrame) -> pd.DataFrame:
    if (b["problem_id"] == 0).any():
        raise RuntimeError("sandbox crashed")
    ok = (b["solution_id"] + b["test_id"]) % 2 == 0
    return pd.DataFrame({
        "problem_id": b["problem_id"], "solution_id": b["solution_id"], "test_id": b["test_id"],
        "pass": ok, "reason": ok.map({True: "pass", False: "syntax_error"}),
        "error_message": None, "time_limit": 1.0,
    })


def test_one_failing_solution_loses_only_itself(spark):
    """Whatever the Arrow batch size and the partitioning: one unit per (problem, solution)."""
    cells = spark.createDataFrame([(p, s, t) for p in range(4) for s in range(10) for t in range(5)], "problem_id long, solution_id long, test_id long")

    def one_raises(b):
        assert b["solution_id"].nunique() == b["problem_id"].nunique() == 1 and list(b["test_id"]) == list(range(5))
        if b["problem_id"].iloc[0] == 1 and b["solution_id"].iloc[0] == 3:
            raise RuntimeError("sandbox crashed")
        return pd.DataFrame({"problem_id": b["problem_id"], "solution_id": b["solution_id"], "test_id": b["test_id"], "pass": True, "reason": "pass", "error_message": None, "time_limit": 1.0})

    seen = []
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size, n in (("7", 1), ("10000", 8), ("10000", 200)):
            spark.conf.set(key, size)
            seen.append(sorted(map(tuple, ev.evaluate_with(cells, one_raises, partitions=n).collect()), key=str))
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 200
    assert [r[:3] for r in seen[0] if not r[3]] == [(1, 3, t) for t in range(5)]
    assert {r[4:6] for r in seen[0] if not r[3]} == {("unexecuted", "RuntimeError: sandbox crashed")}


def test_generated_tests_keep_one_numbering(spark):
    """The generator varies from call to call; ids stay dense because it is called once."""
    from suiteforge.operators.suites import append_suites
    from suiteforge.plans.evolve import CACHE_SCHEMA, generate_tests

    def prompts(kind):
        return spark.createDataFrame([(p, kind, f"{kind} {p}", f"{kind}{p}") for p in range(20)], "problem_id long, kind string, prompt string, hash_id string")

    def varying(b):
        import json
        import random

        answers = [json.dumps({"question": "q", "tests": [f"assert f({random.random()})" for _ in range(random.randint(1, 4))]}) for _ in b["hash_id"]]
        return pd.DataFrame({"hash_id": b["hash_id"], "response": answers})

    first, cache = generate_tests(prompts("diverse"), spark.createDataFrame([], CACHE_SCHEMA), varying, "first")
    second, _ = generate_tests(prompts("similar"), cache, varying, "second")
    grown = append_suites(first, second)
    ids = {}
    for r in grown.collect():
        ids.setdefault(r.problem_id, []).append(r.new_test_id)
    assert len(ids) == 20 and all(sorted(x) == list(range(len(x))) for x in ids.values())
    assert first.collect() == first.collect()


def test_evaluate_grid_failed_units_become_unexecuted(spark):
    sols = spark.createDataFrame([(p, s, f"code{s}") for p in range(3) for s in range(2)], "problem_id long, solution_id long, code string")
    tests = spark.createDataFrame([(p, t, f"t{t}") for p in range(3) for t in range(3)], "problem_id long, test_id long, test_text string")
    g = ev.evaluate_grid(sols, tests, _evaluator)
    rows = g.collect()
    assert len(rows) == 18
    assert {r.reason for r in rows if r.problem_id == 0} == {"unexecuted"}
    assert {r.reason for r in rows if r.problem_id != 0} == {"pass", "syntax_error"}


def test_retry_syntax_errors_replaces_only_those(spark):
    first = spark.createDataFrame(
        [(1, 0, 0, False, "syntax_error", None, 1.0), (1, 1, 0, True, "pass", None, 1.0)],
        ev.OUTCOME_SCHEMA,
    )
    raw_cells = spark.createDataFrame([(1, 0, 0, "raw"), (1, 1, 0, "raw")], "problem_id long, solution_id long, test_id long, code string")

    def fix(b):
        return pd.DataFrame({"problem_id": b["problem_id"], "solution_id": b["solution_id"], "test_id": b["test_id"],
                             "pass": True, "reason": "pass", "error_message": None, "time_limit": 1.0})

    out = {(r.solution_id): r.reason for r in ev.retry_syntax_errors(first, raw_cells, fix).collect()}
    assert out == {0: "pass", 1: "pass"}


def test_row_failure_default(spark):
    items = spark.createDataFrame([(1,), (2,)], "item long")
    scores = spark.createDataFrame([(1, 0.5, [True, False])], "item long, score double, test_pass array<boolean>")
    got = {r.item: (r.score, r.test_pass, r.defaulted) for r in oc.row_failure_default(items, scores, ["item"]).collect()}
    assert got == {1: (0.5, [True, False], False), 2: (0.0, [False], True)}


def test_cost_spread_balances(spark):
    from suiteforge.operators.evaluate import cost_spread, partition_keys

    keys = partition_keys(spark, 8).collect()
    assert sorted(r.bucket for r in keys) == list(range(8))
    # skewed costs: solution s of each problem costs s**2
    cells = spark.createDataFrame(
        [(p, s, t, float(s * s)) for p in range(20) for s in range(16) for t in range(2)],
        "problem_id long, solution_id long, test_id long, cost double",
    )
    spread = cost_spread(cells, "cost", 8)
    per = {r.pid: r.c for r in spread.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("cost").alias("c")).collect()}
    assert len(per) == 8
    assert max(per.values()) <= 1.2 * min(per.values())
    # every solution's cells stay together
    owners = spread.withColumn("pid", F.spark_partition_id()).groupBy("problem_id", "solution_id").agg(F.countDistinct("pid").alias("k"))
    assert owners.where("k > 1").count() == 0
    assert spread.count() == cells.count()


def test_evaluate_with_cost_same_results(spark):
    def ok(b):
        good = (b["solution_id"] + b["test_id"]) % 3 != 0
        return pd.DataFrame({"problem_id": b["problem_id"], "solution_id": b["solution_id"], "test_id": b["test_id"],
                             "pass": good, "reason": good.map({True: "pass", False: "fail"}),
                             "error_message": None, "time_limit": 1.0})

    cells = spark.createDataFrame(
        [(p, s, t, float(s + 1)) for p in range(5) for s in range(6) for t in range(4)],
        "problem_id long, solution_id long, test_id long, cost double",
    )
    a = sorted(map(tuple, ev.evaluate_with(cells, ok).collect()))
    b = sorted(map(tuple, ev.evaluate_with(cells, ok, cost="cost").collect()))
    assert a == b and len(a) == 120


def test_generate_with_cost_spread(spark):
    items = _items(spark).withColumn("plen", F.length("prompt").cast("double"))
    empty = spark.createDataFrame([], "hash_id string, response string, seq long")
    a = sorted(map(tuple, ca.generate_with(items, empty, _gen).collect()))
    b = sorted(map(tuple, ca.generate_with(items, empty, _gen, cost="plen").collect()))
    assert a == b and len(a) == items.select("hash_id").distinct().count()


def _cells(n, tests=4):
    return pd.DataFrame([(s // 16, s % 16, t) for s in range(n) for t in range(tests)], columns=["problem_id", "solution_id", "test_id"])


def test_results_of_many_solutions_are_handed_over_together():
    """One small frame a solution made the hand-over cost more than the hook."""
    done = [(u, u.assign(**{"pass": True})) for u in ev._units(iter([_cells(500)]), ["problem_id", "solution_id"])]
    schema = pa.schema([("problem_id", pa.int64()), ("solution_id", pa.int64()), ("test_id", pa.int64()), ("pass", pa.bool_())])
    assert len(done) == 500
    frames = list(ev._checked(done, [], schema))
    assert len(frames) == 1 and len(frames[0]) == 2000


def test_a_wrong_type_among_alike_results_fails_its_solution_only():
    units = list(ev._units(iter([_cells(6)]), ["problem_id", "solution_id"]))
    schema = pa.schema([("problem_id", pa.int64()), ("solution_id", pa.int64()), ("test_id", pa.int64()), ("pass", pa.bool_()), ("reason", pa.string()), ("error_message", pa.string())])
    done = []
    for i, u in enumerate(units):
        done.append((u, u.assign(**{"pass": pd.Series([True] * 4, dtype=object) if i != 2 else pd.Series(["yes"] * 4, dtype=object), "reason": "pass", "error_message": None})))
    found = pd.concat(ev._checked(done, [], schema)).sort_values(["solution_id", "test_id"])
    assert len(found) == 24
    bad = found[found["reason"] == "unexecuted"]
    assert set(bad["solution_id"]) == {2} and len(bad) == 4 and not bad["pass"].any() and bad["error_message"].str.startswith("ArrowInvalid").all()


def test_units_across_batches_and_great_ids():
    """Ids that are equal as doubles are two solutions; a unit cut by a batch border is one."""
    b = pd.DataFrame({"problem_id": 1, "solution_id": [2**53, 2**53 + 1, 2**53 + 1], "test_id": [0, 0, 1]})
    c = pd.DataFrame({"problem_id": [1, 2], "solution_id": [2**53 + 1, 2**53 + 1], "test_id": [2, 0]})
    assert [list(u["test_id"]) for u in ev._units(iter([b, b.iloc[:0], c]), ["problem_id", "solution_id"])] == [[0], [0, 1, 2], [0]]
