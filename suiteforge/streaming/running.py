"""I1 with keyed state: running outcome counts that a stream keeps up to date.

Result drops land as files of (problem, solution, test, pass, ..., ``order``).
Of several results for one cell the greatest ``order`` wins, at equal order a
pass: the winner depends on the rows alone, not on the sequence or number of
their deliveries, so the counts equal a batch aggregate of all winners.

The state of a key, (problem, block of ``SOLUTION_BLOCK`` solutions, block of
``TEST_BLOCK`` tests), holds the winner of each of its cells, a bounded array;
many solutions share a key, so a batch calls Python once for about a thousand
cells, not for every solution.  A micro-batch touches the keys of its
own rows only; each gives the *changes* of its counts.  A batch writes the
summed changes by solution and by test to the folder of its number, replacing
it, so a batch that runs again after a failure counts once.  Running counts are
the sums of these narrow tables; no result is read twice and no stored table is
scanned by a batch.

Defined results: a null pass counts as not passed; rows with a null id or order
are left out (``orders`` below any other can be used for unordered sources);
an empty drop changes nothing.  A checkpoint belongs to the block sizes it was
made with: compact the counts and start a new one when they change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.outcomes import P, S, T

#: Solutions and tests in one state key, which so holds 1,024 cells at most.
SOLUTION_BLOCK = TEST_BLOCK = 32

CHANGES = f"{P} long, {S} long, {T} long, n_tests long, n_pass long"
STATE = "solutions array<long>, tests array<long>, orders array<long>, passes array<boolean>"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a key's new results into its state; one row for every cell that is new or changed its winner."""
    parts = [(b[S].to_numpy(np.int64), b[T].to_numpy(np.int64), b["order"].to_numpy(np.int64), b["pass"].eq(True).to_numpy(bool)) for b in batches]
    n_old = 0
    if state.exists:
        solutions, tests, orders, passes = state.get
        n_old = len(tests)
        parts.append((np.array(solutions, np.int64), np.array(tests, np.int64), np.array(orders, np.int64), np.array(passes, bool)))
    solution, test, order, won = (np.concatenate(c) for c in zip(*parts, strict=True))
    old = np.arange(len(test)) >= len(test) - n_old
    at = np.lexsort((won, order, test, solution))
    solution, test, order, won, old = solution[at], test[at], order[at], won[at], old[at]
    change = np.flatnonzero((solution[1:] != solution[:-1]) | (test[1:] != test[:-1]))
    first, last = np.concatenate(([0], change + 1)), np.concatenate((change, [len(test) - 1]))  # of each cell's rows; the last wins
    is_new = ~np.logical_or.reduceat(old, first)
    step = won[last].astype(np.int64) - np.logical_or.reduceat(old & won, first).astype(np.int64)
    state.update(tuple(c[last].tolist() for c in (solution, test, order, won)))
    at = np.flatnonzero(is_new | (step != 0))
    yield pd.DataFrame({P: key[0], S: solution[last][at], T: test[last][at], "n_tests": is_new[at].astype(np.int64), "n_pass": step[at]})


def run_counts(spark: SparkSession, source_dir: str, counts_dir: str, checkpoint: str, schema, files_per_batch: int = 1000) -> None:
    """Take in what is new in ``source_dir`` since the checkpoint and add its changes below ``counts_dir``."""

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # one pass of the state for the two sums
        for name, by, n in (("solutions", S, "n_tests"), ("tests", T, "n_solutions")):
            sums = batch.groupBy(P, by).agg(F.sum("n_tests").alias(n), F.sum("n_pass").alias("n_pass"))
            sums.write.mode("overwrite").parquet(f"{counts_dir}/{name}/batch={number}")
        batch.unpersist()

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    rows = rows.select(F.col(P).cast("long"), F.col(S).cast("long"), F.col(T).cast("long"), "pass", F.col("order").cast("long")).dropna(subset=[P, S, T, "order"])
    keyed = rows.withColumn("solutions", F.floor(F.col(S) / SOLUTION_BLOCK)).withColumn("tests", F.floor(F.col(T) / TEST_BLOCK)).groupBy(P, "solutions", "tests")
    query = (
        keyed.applyInPandasWithState(_changes, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
        .writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def running_counts(spark: SparkSession, counts_dir: str, axis: str) -> DataFrame:
    """(problem, solution, n_tests, n_pass) for axis ``solutions``, (problem, test, n_solutions, n_pass) for ``tests``."""
    by, n = {"solutions": (S, "n_tests"), "tests": (T, "n_solutions")}[axis]
    changes = spark.read.parquet(f"{counts_dir}/{axis}")
    return changes.groupBy(P, by).agg(F.sum(n).alias(n), F.sum("n_pass").alias("n_pass"))


def compact_counts(spark: SparkSession, counts_dir: str, axis: str, to_dir: str) -> None:
    """Write the running counts as one batch of changes below ``to_dir`` (run between streams; the old folder can go after it)."""
    running_counts(spark, counts_dir, axis).write.mode("overwrite").parquet(f"{to_dir}/{axis}/batch=-1")
