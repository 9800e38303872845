"""Final curation of test suites as one DataFrame chain.

weak filter -> keep at most ``cap`` tests per identical pattern -> drop
problems with fewer than ``min_tests`` tests -> drop problems with more than
``max_perfect_solutions`` perfect solutions (rates recomputed on the kept
tests) -> dense re-index of the kept tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.outcomes import P, T
from ..operators.suites import dedup_tests, keep_outcomes, max_perfect
from ..operators.outcomes import solution_pass_rate


def final_curation(
    outcomes: DataFrame,
    min_tests: int = 5,
    max_perfect_solutions: int = 60,
    cap: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Curated suites: (problem_id, test_id, new_test_id, n_tests, n_perfect).

    Suite size and the dense re-index are one window over the kept tests
    (same partitioning by problem); only the perfect-solution count needs a
    join back, and it is one row per problem.
    """
    kept = dedup_tests(outcomes, keep=cap, seed=seed)
    by_p = Window.partitionBy(P)
    kept = (
        kept.withColumn("n_tests", F.count(F.lit(1)).over(by_p).cast("long"))
        .withColumn("new_test_id", (F.row_number().over(by_p.orderBy(T)) - 1).cast("long"))
        .where(F.col("n_tests") >= min_tests)
    )
    rates = solution_pass_rate(keep_outcomes(outcomes, kept.select(P, T)))
    ok = max_perfect(rates, max_perfect_solutions)
    return kept.join(ok, P).select(P, T, "new_test_id", "n_tests", "n_perfect")
