"""Registered queries for suite appends, the nested form, incremental ingest and
an evolution round (M6/M8)."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import fx_outcomes, with_fx
from ..operators import suites as su
from ..operators.evaluate import evaluate_with, retry_syntax_errors
from ..operators.outcomes import P, S, T, complete_grid
from ..schemas import from_nested, to_nested
from ..session import ensure_checkpoint_dir
from ..streaming.incremental import ingest_outcomes
from ..streaming.running import run_counts, running_counts
from .evolve import evolve_round
from .matrix_queries import TMEAN, kept_sql
from .registry import register

APPEND_SQL = with_fx(
    """SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY r, test_id) - 1 AS BIGINT) AS new_test_id,
              test_id AS source_test_id, origin, test_text
       FROM (SELECT problem_id, test_id, 'seed-' || CAST(test_id AS VARCHAR) AS test_text, 'seed' AS origin, 0 AS r
             FROM (SELECT DISTINCT problem_id, test_id FROM fx_outcomes)
             UNION ALL SELECT problem_id, test_id, 'first-' || CAST(test_id AS VARCHAR), 'first', 1 FROM fx_tmean
                       WHERE mean >= CAST(0.1 AS DOUBLE)
             UNION ALL SELECT problem_id, test_id, 'second-' || CAST(test_id AS VARCHAR), 'second', 2 FROM fx_kept1)""",
    TMEAN,
    kept_sql(1),
)


@register("append_suites", APPEND_SQL)
def q_append_suites(spark, sf):
    o = fx_outcomes(spark, sf)

    def tagged(df, origin):
        return df.select(P, T, F.concat(F.lit(origin + "-"), F.col(T).cast("string")).alias("test_text"), F.lit(origin).alias("origin"))

    seed = tagged(o.select(P, T).distinct(), "seed")
    first = tagged(su.surviving_tests(o), "first")
    second = tagged(su.dedup_tests(o, keep=1, seed=42), "second")
    return su.append_suites(seed, first, second)


@register(
    "nested_roundtrip",
    with_fx(
        """SELECT problem_id, solution_id, 3 * test_id + 1 AS test_id, pass, reason, 'message ' || CAST(test_id AS VARCHAR) AS error_message,
                  CAST(test_id AS DOUBLE) / 4 AS time_limit FROM fx_outcomes WHERE problem_id % 5 <> 0
           UNION ALL SELECT DISTINCT problem_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR),
                  CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM fx_outcomes WHERE problem_id % 5 = 0"""
    ),
)
def q_nested_roundtrip(spark, sf):
    """Sparse test ids, all detail columns, and every fifth problem without results."""
    o = fx_outcomes(spark, sf)
    sparse = o.where(F.col(P) % 5 != 0).select(
        P, S, (3 * F.col(T) + 1).alias(T), "pass", "reason", F.concat(F.lit("message "), F.col(T).cast("string")).alias("error_message"),
        (F.col(T).cast("double") / 4).alias("time_limit"),
    )
    return from_nested(to_nested(sparse, o.select(P)))


@register("incremental_outcomes", with_fx("SELECT problem_id, solution_id, test_id, pass, reason FROM fx_outcomes"))
def q_incremental_outcomes(spark, sf):
    """The grid delivered as four file drops (one repeats a slice) and ingested by a stream."""
    o = fx_outcomes(spark, sf)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    src = f"{base}/incoming"
    for i in range(3):
        o.where(F.col(P) % 3 == i).write.mode("append").parquet(src)
    o.where(F.col(P) % 3 == 0).write.mode("append").parquet(src)  # a re-delivered drop
    return ingest_outcomes(spark, src, f"{base}/table", f"{base}/stream-checkpoint", o.schema)


#: Every result of the grid; a re-delivered third; later results that win (order 2) and older ones that lose (order 0).
DROPS_SQL = """fx_drops AS (
  SELECT problem_id, solution_id, test_id, pass, 1 AS ord FROM fx_outcomes
  UNION ALL SELECT problem_id, solution_id, test_id, NOT pass, 2 FROM fx_outcomes WHERE (problem_id + test_id) % 4 = 1
  UNION ALL SELECT problem_id, solution_id, test_id, NOT pass, 0 FROM fx_outcomes WHERE (problem_id + solution_id) % 4 = 2),
fx_won AS (SELECT problem_id, solution_id, test_id, arg_max(pass, ord) AS pass FROM fx_drops GROUP BY ALL)"""


def _streamed_counts(spark, sf, axis):
    """The grid in drops, one re-delivered and two that conflict, taken in by two runs of the stream, a few files a batch."""
    o = fx_outcomes(spark, sf).select(P, S, T, "pass")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/running-{uuid.uuid4().hex}"
    source, counts = f"{base}/incoming", f"{base}/counts"
    files = max(2, o.rdd.getNumPartitions())  # of a drop: as many tasks write it as hold the grid
    batch = -(-3 * files // 2)  # a run of two drops is two batches

    def drop(rows, order):
        rows.withColumn("order", F.lit(order).cast("long")).coalesce(files).write.mode("append").parquet(source)

    turned = o.withColumn("pass", ~F.col("pass"))
    schema = o.withColumn("order", F.lit(1).cast("long")).schema
    drop(o.where(F.col(P) % 3 != 1), 1)
    drop(turned.where((F.col(P) + F.col(T)) % 4 == 1), 2)
    run_counts(spark, source, counts, f"{base}/stream", schema, files_per_batch=batch)
    drop(o.where(F.col(P) % 3 != 0), 1)  # a third of the grid for the second time
    drop(turned.where((F.col(P) + F.col(S)) % 4 == 2), 0)
    run_counts(spark, source, counts, f"{base}/stream", schema, files_per_batch=batch)
    return running_counts(spark, counts, axis)


@register("running_solution_counts", with_fx("SELECT problem_id, solution_id, count(*) AS n_tests, count(*) FILTER (pass) AS n_pass FROM fx_won GROUP BY ALL", DROPS_SQL))
def q_running_solution_counts(spark, sf):
    return _streamed_counts(spark, sf, "solutions")


@register("running_test_counts", with_fx("SELECT problem_id, test_id, count(*) AS n_solutions, count(*) FILTER (pass) AS n_pass FROM fx_won GROUP BY ALL", DROPS_SQL))
def q_running_test_counts(spark, sf):
    return _streamed_counts(spark, sf, "tests")


def _recorded_evaluator(unit: pd.DataFrame) -> pd.DataFrame:
    """Hands back the recorded outcomes of a solution: code that does not compile is a syntax error; some units break the hook itself."""
    fault = unit["fault"].iat[0]
    if fault == "raise":
        raise RuntimeError("lost its sandbox")
    recorded = unit["recorded"].to_numpy()
    try:
        compile(unit["code"].iat[0], "solution", "exec")
    except SyntaxError as e:
        found = {"pass": False, "reason": "syntax_error", "error_message": f"SyntaxError: {type(e).__name__}"}
    else:
        found = {"pass": recorded, "reason": np.where(recorded, "pass", "fail").astype(object), "error_message": None}
    if fault == "type":
        found["pass"] = "yes"
    out = pd.DataFrame({**{c: unit[c].to_numpy() for c in (P, S, T)}, **found, "time_limit": 1.0})
    return out[out[T] % 20 != 7] if fault == "short" else out


@register(
    "evaluate_failures",
    with_fx(
        """SELECT problem_id, solution_id, test_id,
                  CASE WHEN k IN (0, 1) OR (k = 2 AND test_id % 20 = 7) THEN false ELSE pass END AS pass,
                  CASE WHEN k IN (0, 1) OR (k = 2 AND test_id % 20 = 7) THEN 'unexecuted' WHEN pass THEN 'pass' ELSE 'fail' END AS reason,
                  CASE k WHEN 0 THEN 'RuntimeError' WHEN 1 THEN 'ArrowInvalid' END AS error
           FROM (SELECT *, (problem_id + solution_id) % 7 AS k FROM fx_outcomes)"""
    ),
)
def q_evaluate_failures(spark, sf):
    """One call per solution; units that raise, return wrong types or leave tests out; code with a syntax error is run again on the raw text."""
    o = fx_outcomes(spark, sf)
    kind = (F.col(P) + F.col(S)) % 7
    fault = F.when(kind == 0, "raise").when(kind == 1, "type").when(kind == 2, "short").otherwise("")
    raw = F.concat(F.lit("def f(x):\n    return x + "), F.col(S).cast("string"))
    cells = o.select(P, S, T, F.col("pass").alias("recorded"), fault.alias("fault"), raw.alias("raw"))
    first = cells.withColumn("code", F.when(F.col(S) % 4 == 1, F.concat(F.lit("Sure: "), "raw")).otherwise(F.col("raw")))
    found = retry_syntax_errors(evaluate_with(first, _recorded_evaluator), cells.withColumnRenamed("raw", "code"), _recorded_evaluator)
    grid = complete_grid(found, o.select(P, S).distinct(), o.select(P, T).distinct(), hot=False)
    errors = found.select(P, S, T, F.split_part("error_message", F.lit(":"), F.lit(1)).alias("error"))
    return grid.select(P, S, T, "pass", "reason").join(errors, [P, S, T], "left")


def _stub_generator(b: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model: reads the task from the prompt, answers in four shapes (one a failure)."""

    def answer(prompt: str) -> str:
        task, kind = re.match(r"Task (\d+) \((\w+)\)", prompt).groups()
        tests = [f"assert sol({task}) != {hashlib.md5(f'{task}|{kind}|{i}'.encode()).hexdigest()[:6]}" for i in range(2)]
        whole = json.dumps({"question": f"task {task}", "tests": tests})
        return (whole, f"Here:\n```json\n{whole}\n```", whole[:-12], "ERROR: Timeout after 3 attempts")[int(task) % 4]

    return pd.DataFrame({"hash_id": b["hash_id"], "response": b["prompt"].map(answer)})


def _stub_evaluator(b: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a sandbox: pass decided by the md5 of (solution, test text)."""
    ok = [hashlib.md5(f"{s}|{t}".encode()).hexdigest()[0] <= "9" for s, t in zip(b[S].tolist(), b["test_text"].tolist(), strict=True)]
    reason = ["pass" if k else "fail" for k in ok]
    return pd.DataFrame({**{c: b[c].to_numpy() for c in (P, S, T)}, "pass": ok, "reason": reason, "error_message": None, "time_limit": 1.0})


def evolve_inputs(spark, sf):
    """(outcomes, tests, solutions, problems) of the fixture."""
    o = fx_outcomes(spark, sf)
    tests = o.select(P, T).distinct().withColumn("test_text", F.concat(F.lit("assert seed("), F.col(T).cast("string"), F.lit(")")))
    sols = o.select(P, S).distinct().withColumn("code", F.concat(F.lit("def f(): return "), F.col(S).cast("string")))
    return o, tests, sols, o.select(P).distinct().withColumn("question", F.concat(F.lit("question "), F.col(P).cast("string")))


EVOLVE_SQL = with_fx(
    """SELECT problem_id, solution_id, test_id, ok AS pass, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS reason
       FROM (SELECT s.problem_id, s.solution_id, t.test_id, left(md5(CAST(s.solution_id AS VARCHAR) || '|' || t.test_text), 1) <= '9' AS ok
             FROM (SELECT DISTINCT problem_id, solution_id FROM fx_outcomes) s JOIN fx_suite t USING (problem_id))""",
    TMEAN,
    """fx_alive AS (SELECT DISTINCT problem_id FROM fx_tmean WHERE mean >= CAST(0.1 AS DOUBLE))""",
    """fx_new AS (
      SELECT problem_id, r, i AS test_id,
             CASE WHEN problem_id % 4 = 3 THEN 'assert False'
                  ELSE 'assert sol(' || problem_id || ') != ' || left(md5(problem_id || '|' || kind || '|' || i), 6) END AS test_text
      FROM fx_alive, (VALUES ('diverse', 1), ('similar', 2)) k(kind, r), (VALUES (0), (1)) n(i)
      WHERE i = 0 OR problem_id % 4 < 2)""",
    """fx_suite AS (
      SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY r, test_id) - 1 AS BIGINT) AS test_id, test_text
      FROM (SELECT DISTINCT problem_id, 0 AS r, test_id, 'assert seed(' || test_id || ')' AS test_text FROM fx_outcomes SEMI JOIN fx_alive USING (problem_id)
            UNION ALL SELECT problem_id, r, test_id, test_text FROM fx_new))""",
)


@register("evolve_round", EVOLVE_SQL)
def q_evolve_round(spark, sf):
    """S3 with deterministic hooks: prompts, cache, salvage (whole, fenced, cut off, failed), append, evaluation."""
    o, tests, sols, problems = evolve_inputs(spark, sf)
    _, outcomes2, _ = evolve_round(o, tests, sols, _stub_generator, _stub_evaluator, problems, seed=42)
    return outcomes2.select(P, S, T, "pass", "reason")
