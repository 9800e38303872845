"""Test-suite curation on the outcome table: weak filter, pattern dedup/cap,
suite-size filters, re-indexing, appends (B7-B10, B13, C12, D4, D7, E4, E5,
E11, G2, G3).

Random choices are reproducible and partition-independent: a test's draw is
``md5(seed|problem_id|test_id)``, so the same rows survive under any number of
partitions or executors, and a retried task recomputes the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..session import cut_lineage
from .outcomes import P, S, T, solution_pass_rate, test_pattern_keys

WEAK_THRESHOLD = 0.1  # fixed value: a test is weak when its pass fraction is strictly below this


def seeded_key(seed: int, *cols: str) -> Column:
    """The seeded draw used for every random choice: md5 over ``seed|k1|k2...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def weak_tests(outcomes: DataFrame, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """Tests whose pass fraction over solutions is < threshold (strict)."""
    return (
        outcomes.groupBy(P, T)
        .agg(F.avg(F.col("pass").cast("int")).alias("mean"))
        .where(F.col("mean") < threshold)
    )


def weak_test_lists(outcomes: DataFrame, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """The sorted weak test ids of each problem (the per-problem index list)."""
    return weak_tests(outcomes, threshold).groupBy(P).agg(F.sort_array(F.collect_list(T)).alias("weak_test_ids"))


def _keys_with_weak(outcomes: DataFrame, threshold: float) -> DataFrame:
    return test_pattern_keys(outcomes).withColumn("weak", F.col("mean") < threshold)


def dedup_tests(outcomes: DataFrame, keep: int = 1, seed: int = 42, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """E4/E5 + G3: surviving tests after the weak filter and the pattern cap.

    Non-weak tests are grouped by identical outcome pattern; each group keeps
    ``keep`` members drawn by the seeded hash (E4: keep=1, E5: keep=5).  The
    result is ``all - (weak | capped)`` as (problem_id, test_id).

    keep=1 is a map-side-combined ``min_by``; keep>1 is a ``row_number``
    filter, which Spark plans as a partial group limit before the exchange.
    """
    keys = _keys_with_weak(outcomes, threshold).where(~F.col("weak"))
    grp = [P, "pat_h1", "pat_h2", "n_pass"]
    draw = seeded_key(seed, P, T)
    if keep == 1:
        return keys.groupBy(*grp).agg(F.min_by(T, draw).alias(T)).select(P, T)
    w = Window.partitionBy(*grp).orderBy(draw)
    return keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).select(P, T)


def surviving_tests(outcomes: DataFrame, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """Tests that pass the weak filter only (step 3.1)."""
    return (
        outcomes.groupBy(P, T)
        .agg(F.avg(F.col("pass").cast("int")).alias("mean"))
        .where(F.col("mean") >= threshold)
        .select(P, T)
    )


def keep_outcomes(outcomes: DataFrame, kept_tests: DataFrame) -> DataFrame:
    """Outcomes of surviving tests only (left semi join)."""
    return outcomes.join(kept_tests.select(P, T), [P, T], "left_semi")


def refiltered_pass_rate(outcomes: DataFrame, kept_tests: DataFrame) -> DataFrame:
    """Pass rate per solution over the surviving tests; an empty suite scores 0.0."""
    solutions = outcomes.select(P, S).distinct()
    return solution_pass_rate(keep_outcomes(outcomes, kept_tests), solutions)


def nonempty_problems(problems: DataFrame, kept_tests: DataFrame) -> DataFrame:
    """Problems with at least one surviving test."""
    return problems.join(kept_tests.select(P).distinct(), P, "left_semi")


def min_suite(kept_tests: DataFrame, min_tests: int = 5) -> DataFrame:
    """Problems whose curated suite has at least ``min_tests`` tests."""
    return kept_tests.groupBy(P).agg(F.count(F.lit(1)).alias("n_tests")).where(F.col("n_tests") >= min_tests)


def max_perfect(rates: DataFrame, max_perfect_solutions: int = 60) -> DataFrame:
    """Problems with at most ``max_perfect_solutions`` solutions at pass rate 1.0."""
    return (
        rates.groupBy(P)
        .agg(F.sum((F.col("pass_rate") == 1.0).cast("int")).cast("long").alias("n_perfect"))
        .where(F.col("n_perfect") <= max_perfect_solutions)
    )


def reindex_tests(kept_tests: DataFrame) -> DataFrame:
    """Dense new index 0..m-1 of the surviving tests of each problem, in old order."""
    w = Window.partitionBy(P).orderBy(T)
    return kept_tests.select(P, T, (F.row_number().over(w) - 1).cast("long").alias("new_test_id"))


ORIGIN_RANK = {"seed": 0, "first": 1, "second": 2}  # fixed order of appended suites


def append_suites(*suites: DataFrame) -> DataFrame:
    """Raw ++ first ++ second per problem, order kept, no de-dup.

    Each input is (problem_id, test_id, test_text, origin).  The new test id
    is the position in the concatenation: offset by the sizes of the earlier
    origins of the same problem plus its place among its own origin's tests.
    The union is cut from its lineage first: a generator behind a suite runs
    once, and sizes and rows see the same tests.
    """
    u = suites[0]
    for s in suites[1:]:
        u = u.unionByName(s)
    rank = F.coalesce(*[F.when(F.col("origin") == k, F.lit(v)) for k, v in ORIGIN_RANK.items()], F.lit(99))
    u = cut_lineage(u.withColumn("_rank", rank))
    sizes = u.groupBy(P, "_rank").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(P).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(P, "_rank", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    wl = Window.partitionBy(P, "_rank").orderBy(T, "test_text")
    return (
        u.join(offsets, [P, "_rank"])
        .withColumn("new_test_id", (F.col("_off") + F.row_number().over(wl) - 1).cast("long"))
        .select(P, "new_test_id", F.col(T).alias("source_test_id"), "origin", "test_text")
    )


def suite_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean suite size before/after a filter, the drop and its percent, and removed problems.

    ``before``/``after`` are (problem_id, test_id) tables.
    """
    nb = before.groupBy(P).agg(F.count(F.lit(1)).alias("nb"))
    na = after.groupBy(P).agg(F.count(F.lit(1)).alias("na"))
    s = nb.join(na, P, "full").agg(
        F.avg("nb").alias("avg_before"),
        F.avg("na").alias("avg_after"),
        F.count("nb").alias("problems_before"),
        F.count("na").alias("problems_after"),
    )
    return s.select(
        round6("avg_before").alias("avg_before"),
        round6("avg_after").alias("avg_after"),
        round6(F.col("avg_before") - F.col("avg_after")).alias("avg_removed"),
        round6((F.col("avg_before") - F.col("avg_after")) / F.col("avg_before") * 100).alias("pct_removed"),
        "problems_before",
        "problems_after",
        (F.col("problems_before") - F.col("problems_after")).alias("problems_removed"),
    )
