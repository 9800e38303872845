"""S3: one evolution round as DataFrame stages.

weak filter -> diverse five -> prompts -> responses ("first") -> pattern dedup
on the old tests -> similar five -> prompts -> responses ("second") -> append
to the raw suite -> evaluate every solution on the grown suite.

A prompt carries the question, the picked programs, the tests still in use and
their outcome matrix.  Prompts are keyed by their content hash: a cached
response is used, only the rest is generated (once per hash), and the new rows
join the cache.  Responses are salvaged like any model text, and missing or
empty test lists become the sentinel.  Generation and evaluation are user
hooks; each stage's output is cut from its lineage, so a hook runs once and a
lost executor only recomputes one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import text_key
from ..functions.salvage import fill_sentinel, parse_responses
from ..functions.text import render_bool_list, render_prompt, render_rows
from ..operators.cache import GeneratorFn, attach_cached, generate_with
from ..operators.evaluate import EvaluatorFn, evaluate_grid
from ..operators.outcomes import P, S, T
from ..operators.select import diverse_five, similar_five
from ..operators.suites import append_suites, dedup_tests, keep_outcomes, surviving_tests
from ..session import cut_lineage

TEMPLATE = """Task {problem} ({kind})
{question}

Programs:
{programs}

Tests:
{tests}

Outcomes of the programs on the tests:
{matrix}
"""
CACHE_SCHEMA = "hash_id string, response string, seq long"


def selection_prompts(outcomes: DataFrame, picks: DataFrame, kind: str, problems: DataFrame, solutions: DataFrame, tests: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(problem, kind, prompt, hash_id): the template filled for each problem with picks.

    Five programs at most and the filtered suite of one problem make a prompt:
    its slots are per-problem lists by definition.
    """
    o = outcomes.join(picks.select(P, S, "slot"), [P, S])
    rows = o.groupBy(P, S, "slot").agg(
        render_bool_list(F.transform(F.sort_array(F.collect_list(F.struct(T, "pass"))), lambda x: x["pass"])).alias("row")
    )
    listed = rows.join(solutions.select(P, S, "code"), [P, S], "left").groupBy(P).agg(F.sort_array(F.collect_list(F.struct("slot", S, "row", "code"))).alias("rows"))
    suite = tests.join(outcomes.select(P, T).distinct(), [P, T], "left_semi").groupBy(P).agg(F.sort_array(F.collect_list(F.struct(T, "test_text"))).alias("suite"))
    program = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("# program "), (i + 1).cast("string"), F.lit("\n"), F.coalesce(r["code"], F.lit("")))), "\n\n")
    filled = listed.join(suite, P, "left").join(problems.select(P, "question"), P, "left")
    prompt = render_prompt(
        template,
        problem=F.col(P).cast("string"),
        kind=F.lit(kind),
        matrix=render_rows(F.transform("rows", lambda r: r["row"])),
        tests=F.array_join(F.transform("suite", lambda t: t["test_text"]), "\n"),
        programs=program,
        question=F.col("question"),
    )
    return filled.select(P, F.lit(kind).alias("kind"), prompt.alias("prompt")).withColumn("hash_id", text_key("prompt"))


def generate_tests(prompts: DataFrame, cache: DataFrame, fn: GeneratorFn, origin: str) -> tuple[DataFrame, DataFrame]:
    """New tests of each problem (ids by place in the response) and the grown cache.

    Failures are cached as ``ERROR:`` text; they and unreadable responses give
    the sentinel test.
    """
    prompts = cut_lineage(prompts)
    new = generate_with(prompts, cache, fn)
    cache = cut_lineage(cache.select("hash_id", "response", "seq").unionByName(new))
    answered = attach_cached(prompts, cache).select(P, "response")
    read = parse_responses(answered, "response", problem="question_text", tests="found")
    tests = read.select(P, F.posexplode(fill_sentinel("found")).alias("place", "test_text"))
    return tests.select(P, F.col("place").cast("long").alias(T), "test_text", F.lit(origin).alias("origin")), cache


def evolve_round(
    outcomes: DataFrame,
    tests: DataFrame,
    solutions: DataFrame,
    generate: GeneratorFn,
    evaluate: EvaluatorFn,
    problems: DataFrame,
    cache: DataFrame | None = None,
    seed: int = 42,
    done: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run one round; return (grown test suite, outcomes on it, grown cache).

    ``tests`` is (problem_id, test_id, test_text), ``solutions`` is
    (problem_id, solution_id, code), ``problems`` is (problem_id, question);
    ``outcomes`` is the complete grid, ``cache`` the responses so far, ``done``
    outcomes of this round that an earlier, broken run has left (C4).
    """
    cache = cache if cache is not None else outcomes.sparkSession.createDataFrame([], CACHE_SCHEMA)
    surviving = surviving_tests(outcomes)
    o_first = cut_lineage(keep_outcomes(outcomes, surviving))
    picks1 = diverse_five(o_first, seed)
    first, cache = generate_tests(selection_prompts(o_first, picks1, "diverse", problems, solutions, tests), cache, generate, "first")
    o_second = cut_lineage(keep_outcomes(outcomes, dedup_tests(outcomes, keep=1, seed=seed)))
    picks2 = similar_five(o_second, seed)
    second, cache = generate_tests(selection_prompts(o_second, picks2, "similar", problems, solutions, tests), cache, generate, "second")
    # problems whose suite emptied under the weak filter stay out
    alive = surviving.select(P).distinct()
    raw = tests.join(alive, P, "left_semi").select(P, T, "test_text", F.lit("seed").alias("origin"))
    grown = append_suites(raw, first.join(alive, P, "left_semi"), second.join(alive, P, "left_semi"))
    suite = cut_lineage(grown.select(P, F.col("new_test_id").alias(T), "test_text", "origin"))
    new_outcomes = evaluate_grid(solutions.join(alive, P, "left_semi"), suite, evaluate, done=done)
    return suite, cut_lineage(new_outcomes), cache


def run_rounds(
    outcomes: DataFrame,
    tests: DataFrame,
    solutions: DataFrame,
    generate: GeneratorFn,
    evaluate: EvaluatorFn,
    rounds: int,
    base_path: str,
    problems: DataFrame,
    cache: DataFrame | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """S3 repeated: round N reads round N-1's outputs from the round-partitioned
    layout (A10) and writes its own partition, so every round starts from a
    short plan over stored tables and a rerun of one round replaces only it.

    A rerun goes on after the last round whose tests, outcomes and responses
    are stored; the report of the last round ends up in ``base_path/report``.
    """
    from ..operators.stats import report_metrics
    from ..sources.io import path_exists, read_round, write_report, write_round

    spark = outcomes.sparkSession
    for r in range(1, rounds + 1):
        # the responses are written last: where they are, the round is complete
        if path_exists(spark, f"{base_path}/responses/round={r}"):
            continue
        if r > 1:
            tests, outcomes, cache = (read_round(spark, f"{base_path}/{name}", r) for name in ("tests", "outcomes", "responses"))
        suite, new_outcomes, grown = evolve_round(outcomes, tests, solutions, generate, evaluate, problems, cache, seed=seed + r - 1)
        write_round(suite.select(P, T, "test_text"), f"{base_path}/tests", r)
        write_round(new_outcomes, f"{base_path}/outcomes", r)
        write_round(grown, f"{base_path}/responses", r)
    suite, last = read_round(spark, f"{base_path}/tests", rounds + 1), read_round(spark, f"{base_path}/outcomes", rounds + 1)
    write_report(report_metrics(details=last), f"{base_path}/report")
    return suite, last
