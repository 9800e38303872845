"""Evaluation plumbing (C5-C7, J3-J6): fan-out, the user evaluator hook, retries,
test-kind routing and in/out partial scores.

The code sandbox itself is not part of this library: users pass an evaluator
``fn(pandas frame) -> pandas frame`` that gets one solution with its whole
suite, in test order, and returns the outcomes of the tests it ran.  Everything
around it -- which cells to run, defaults for failed units, roll-ups -- is joins
and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.compare import test_kind
from ..session import cut_lineage
from .outcomes import GRID_CHUNK, P, S, T, complete_grid, expand_join
from .suites import reindex_tests

OUTCOME_SCHEMA = "problem_id long, solution_id long, test_id long, pass boolean, reason string, error_message string, time_limit double"

EvaluatorFn = Callable[[pd.DataFrame], pd.DataFrame]


def fanout(solutions: DataFrame, tests: DataFrame) -> DataFrame:
    """Every solution with every test of its problem, keyed (no positional re-assembly).

    Problems with many solutions are cut into slices, so a hot problem's cells
    are many tasks' work.
    """
    return expand_join(solutions, tests, [P], S, GRID_CHUNK)


def partition_keys(spark, n: int) -> DataFrame:
    """(bucket, key): for each partition index 0..n-1 an integer whose ``hash()``
    lands in that partition under ``repartition(n, key)``.  Found among the
    first 64n integers; the table has n rows (a bound fixed by n)."""
    cand = spark.range(64 * n).select(F.col("id").alias("key"), F.pmod(F.hash(F.col("id")), F.lit(n)).alias("bucket"))
    return cand.groupBy("bucket").agg(F.min("key").alias("key"))


def cost_spread(cells: DataFrame, cost: str, n: int, group: tuple[str, ...] = (P, S)) -> DataFrame:
    """Spread evaluation work so every partition gets a similar total cost.

    Groups (one solution's cells by default) are ordered by cost, largest
    first, and dealt round-robin into n buckets (positions come from the
    two-phase row numbering, not a single-partition window); bucket i goes to
    partition i through a key from :func:`partition_keys`.
    """
    from .sampling import row_index

    g = cells.groupBy(*group).agg(F.sum(cost).alias("_cost"))
    ranked = row_index(g.withColumn("_neg", -F.col("_cost")), ["_neg", *group], "_pos")
    buckets = ranked.select(*group, F.pmod(F.col("_pos"), F.lit(n)).cast("long").alias("bucket"))
    keyed = buckets.join(F.broadcast(partition_keys(cells.sparkSession, n)), "bucket", "left")
    # a bucket without a key would lose its cells: stop instead
    missing = F.raise_error(F.concat(F.lit("no partition key for bucket "), F.col("bucket").cast("string"))).cast("long")
    keyed = keyed.withColumn("key", F.coalesce("key", missing))
    return cells.join(keyed.select(*group, "key"), list(group)).repartition(n, "key").drop("key")


def _units(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroups rows that follow each other by key into one frame per key, across batch borders."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        columns = [b[k].to_numpy() for k in keys]
        change = np.zeros(len(b) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), len(b)]
        if held and tuple(c[0] for c in columns) != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        for start, end in zip(starts[:-2], starts[1:-1], strict=True):
            if held:
                yield pd.concat([*held, b.iloc[start:end]], ignore_index=True)
                held = []
            else:
                unit = b.iloc[start:end].copy()
                unit.index = pd.RangeIndex(end - start)
                yield unit
        held.append(b.iloc[starts[-2] :])
        last = tuple(c[-1] for c in columns)
    if held:
        yield pd.concat(held, ignore_index=True)


#: Rows of results that a task checks and hands over at once.
RESULT_ROWS = 10_000


def _unexecuted(units: list[pd.DataFrame], errors: list[Exception], cols: list[str]) -> pd.DataFrame:
    """Failed units: each of their cells with the unit's error as message."""
    cells = pd.concat(units, ignore_index=True)
    messages = np.repeat(np.array([f"{type(e).__name__}: {e}" for e in errors], object), [len(u) for u in units])
    out = pd.DataFrame({c: cells[c] if c in (P, S, T) else [None] * len(cells) for c in cols})
    for c, value in (("pass", False), ("reason", "unexecuted"), ("error_message", messages)):
        if c in cols:
            out[c] = value
    return out


def _checked(done: list[tuple[pd.DataFrame, pd.DataFrame]], failed: list[tuple[pd.DataFrame, Exception]], arrow: pa.Schema) -> Iterator[pd.DataFrame]:
    """(unit, result) pairs and failed units as few frames.

    Results whose columns have the same pandas types are joined and checked
    together, and one by one only where that fails; those not of the stated
    types join the failed.
    """
    alike: dict[tuple, list[tuple[pd.DataFrame, pd.DataFrame]]] = {}
    for unit, out in done:
        alike.setdefault(tuple(out.dtypes.tolist()), []).append((unit, out))
    for pairs in alike.values():
        whole = pd.concat([out for _, out in pairs], ignore_index=True) if len(pairs) > 1 else pairs[0][1]
        try:
            pa.RecordBatch.from_pandas(whole, schema=arrow, preserve_index=False)
        except Exception as error:  # noqa: BLE001 - some unit's
            if len(pairs) == 1:
                failed.append((pairs[0][0], error))
                continue
            good = []
            for unit, out in pairs:
                try:
                    pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
                    good.append(out)
                except Exception as e:  # noqa: BLE001
                    failed.append((unit, e))
            whole = pd.concat(good, ignore_index=True) if good else None
        if whole is not None:
            yield whole
    if failed:
        yield _unexecuted(*zip(*failed, strict=True), arrow.names)


def evaluate_with(
    cells: DataFrame,
    fn: EvaluatorFn,
    schema: str = OUTCOME_SCHEMA,
    partitions: int | None = None,
    cost: str | None = None,
) -> DataFrame:
    """Run a user evaluator over (problem, solution, test) cells.

    ``fn`` is called once per (problem, solution) with all its cells in test
    order, whatever the Arrow batch size.  Solutions are spread over tasks by
    key, or with a ``cost`` column (e.g. expected run time) by total cost
    (:func:`cost_spread`).  When ``fn`` raises, or returns columns that are
    missing or of another type, the unit's cells come out as failed
    ``unexecuted`` rows with the error as message; cells that ``fn`` leaves out
    are marked by :func:`complete_grid` (D25/D26).  The rows are stored, so
    that a second use of the result calls ``fn`` no more.  Keys are not null.
    """
    n = partitions or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cost_spread(cells, cost, n) if cost else cells.repartition(n, P, S)
    cols = [c.split()[0] for c in schema.split(",")]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, failed, rows = [], [], 0
        for unit in _units(batches, [P, S]):
            try:
                out = fn(unit)
                done.append((unit, out if list(out.columns) == cols else out[cols]))
            except Exception as e:  # noqa: BLE001 - one failed unit never aborts the job
                failed.append((unit, e))
            rows += len(unit)
            if rows >= RESULT_ROWS:
                yield from _checked(done, failed, arrow)
                done, failed, rows = [], [], 0
        yield from _checked(done, failed, arrow)

    return cut_lineage(spread.sortWithinPartitions(P, S, T).mapInPandas(run, schema=schema))


def evaluate_grid(solutions: DataFrame, tests: DataFrame, fn: EvaluatorFn, done: DataFrame | None = None) -> DataFrame:
    """J3 + D25/D26: evaluate every cell and complete the grid.

    ``done`` holds outcomes an earlier run has left (C4): a solution with all
    its cells there is not evaluated again, one with some of them is, whole.
    """
    cells = fanout(solutions, tests)
    if done is None:
        raw = evaluate_with(cells, fn)
    else:
        have = done.select(P, S, T, "pass", "reason", "error_message", "time_limit").join(cells.select(P, S, T), [P, S, T], "left_semi")
        missing = cells.select(P, S, T).join(have.select(P, S, T), [P, S, T], "left_anti").select(P, S).distinct()
        fresh = evaluate_with(cells.join(missing, [P, S], "left_semi"), fn)
        raw = have.join(missing, [P, S], "left_anti").unionByName(fresh)
    return complete_grid(raw, solutions.select(P, S), tests.select(P, T))


def retry_syntax_errors(first: DataFrame, raw_cells: DataFrame, fn: EvaluatorFn) -> DataFrame:
    """Cells whose extracted code had a ``syntax_error`` are run again on the raw
    text; the second result replaces the first only for those cells.  ``first`` is
    cut from its lineage, so the evaluator behind it runs once."""
    first = cut_lineage(first)
    bad = first.where(F.col("reason") == "syntax_error").select(P, S).distinct()
    second = evaluate_with(raw_cells.join(bad, [P, S], "left_semi"), fn)
    keep = first.join(bad, [P, S], "left_anti")
    return keep.unionByName(second.select(*first.columns))


def route_by_kind(items: DataFrame, tests_col: str = "tests") -> tuple[DataFrame, DataFrame]:
    """Split rows by test kind; both halves keep their keys, so results
    are joined back by key instead of scattered by position."""
    k = items.withColumn("kind", test_kind(tests_col))
    return k.where(F.col("kind") == "assert"), k.where(F.col("kind") == "io")


def outcomes_of_rungs(compared: DataFrame) -> DataFrame:
    """Cells from compared outputs: a rung other than ``none`` passes; a null rung (no output) is an unexecuted cell.  Other columns stay."""
    reason = F.when(F.col("rung").isNull(), "unexecuted").when(F.col("rung") == "none", "fail").otherwise("pass")
    return compared.withColumn("pass", F.coalesce(F.col("rung") != "none", F.lit(False))).withColumn("reason", reason)


def partial_scores(outcomes: DataFrame, cap: int = 10) -> DataFrame:
    """J6/H28 (intended rule): 1.0 when every test passes, else the pass fraction over
    the first ``cap`` tests of the suite.  Two aggregates; no per-solution arrays."""
    pos = reindex_tests(outcomes.select(P, T).distinct())
    o = outcomes.join(pos, [P, T])
    return o.groupBy(P, S).agg(
        F.bool_and("pass").alias("all_pass"),
        F.avg(F.when(F.col("new_test_id") < cap, F.col("pass").cast("int"))).alias("head_rate"),
    ).select(P, S, F.when(F.col("all_pass"), F.lit(1.0)).otherwise(F.coalesce("head_rate", F.lit(0.0))).alias("score"))
