"""The outcome matrix held as a long table and its aggregates along both axes.

``outcomes(problem_id, solution_id, test_id, pass, reason, ...)`` is the core
table.  Every function here is a DataFrame -> DataFrame transform; nothing is
collected to the driver and no group is gathered into one row unless the
operator's output *is* that row (the rendered matrix, D3).

Pattern identity (D5, D6) uses an order-free set hash: the XOR of two seeded
64-bit hashes of the passing members plus the pass count.  XOR is associative,
so Spark combines it map-side and a hot problem never has to be gathered in
one task to find its identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, S, T = "problem_id", "solution_id", "test_id"


def _int(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("int")


GRID_CHUNK = 4096  # solutions per salt slice when a problem's grid is expanded


def expand_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, chunk: int, hot: bool | None = None
) -> DataFrame:
    """Equi-join whose output per key is |left| x |right|, with hot keys split.

    A key with n left rows is cut into ceil(n / chunk) slices of its left
    side (by a hash of ``left_id``) and its right rows are replicated once per
    slice, so one huge key becomes many tasks; ordinary keys get one slice.
    ``hot`` tells whether any key can exceed ``chunk`` left rows; when the
    caller does not know (None), one planning aggregate (a single number: the
    largest key) decides.  Without hot keys the plain join is used.
    """
    k = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_k"))
    if hot is None:
        hot = (k.agg(F.max("_k")).first()[0] or 1) > 1
    if not hot:
        return left.join(right, keys)
    lft = left.join(k, keys).withColumn("_salt", F.pmod(F.xxhash64(F.col(left_id)), F.col("_k")).cast("int"))
    rgt = right.join(k, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return lft.drop("_k").join(rgt.drop("_k"), [*keys, "_salt"]).drop("_salt")


def complete_grid(
    outcomes: DataFrame,
    solutions: DataFrame | None = None,
    tests: DataFrame | None = None,
    chunk: int = GRID_CHUNK,
    hot: bool | None = None,
) -> DataFrame:
    """Every solution x every test of its problem; missing cells are ``unexecuted`` and fail.

    ``solutions`` / ``tests`` default to the keys seen in ``outcomes``.  Extra
    outcome columns are carried through (null for unexecuted cells).  The
    solution x test expansion is salted for problems with many solutions.
    """
    if solutions is None:
        solutions = outcomes.select(P, S).distinct()
    if tests is None:
        tests = outcomes.select(P, T).distinct()
    grid = expand_join(solutions.select(P, S), tests.select(P, T), [P], S, chunk, hot)
    cols = outcomes.columns
    joined = grid.join(outcomes, [P, S, T], "left")
    has_reason = "reason" in cols
    executed = F.col("pass").isNotNull() if not has_reason else (F.col("pass").isNotNull() | F.col("reason").isNotNull())
    reason = F.when(~executed, F.lit("unexecuted"))
    if has_reason:
        reason = reason.otherwise(F.coalesce(F.col("reason"), F.when(F.col("pass"), "pass").otherwise("fail")))
    else:
        reason = reason.when(F.col("pass"), F.lit("pass")).otherwise(F.lit("fail"))
    extra = [c for c in cols if c not in (P, S, T, "pass", "reason")]
    return joined.select(P, S, T, F.coalesce(F.col("pass"), F.lit(False)).alias("pass"), reason.alias("reason"), *extra)


def solution_pass_rate(outcomes: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    """Pass rate per (problem, solution); a solution with no tests scores 0.0."""
    agg = outcomes.groupBy(P, S).agg(
        F.avg(_int("pass")).alias("pass_rate"),
        F.count(F.lit(1)).alias("n_tests"),
        F.sum(_int("pass")).cast("long").alias("n_pass"),
    )
    if solutions is None:
        return agg
    return solutions.select(P, S).join(agg, [P, S], "left").select(
        P,
        S,
        F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"),
        F.coalesce("n_tests", F.lit(0)).cast("long").alias("n_tests"),
        F.coalesce("n_pass", F.lit(0)).cast("long").alias("n_pass"),
    )


def test_pass_mean(outcomes: DataFrame) -> DataFrame:
    """Mean pass over solutions per (problem, test) -- the "diversity mean"."""
    return outcomes.groupBy(P, T).agg(
        F.avg(_int("pass")).alias("mean"),
        F.count(F.lit(1)).alias("n_solutions"),
        F.sum(_int("pass")).cast("long").alias("n_pass"),
    )


def binary_score(rates: DataFrame, col: str = "pass_rate") -> DataFrame:
    """Continuous pass rate -> 1.0 iff every test passed, else 0.0."""
    return rates.withColumn("score", F.when(F.col(col) == 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))


def _set_hash(member: str, passed: Column) -> list[Column]:
    h1 = F.bit_xor(F.when(passed, F.xxhash64(F.lit(0x5EED1), F.col(member))).otherwise(F.lit(0)))
    h2 = F.bit_xor(F.when(passed, F.xxhash64(F.lit(0x5EED2), F.col(member))).otherwise(F.lit(0)))
    return [h1.alias("pat_h1"), h2.alias("pat_h2"), F.sum(_int(passed)).cast("long").alias("n_pass")]


def test_pattern_keys(outcomes: DataFrame) -> DataFrame:
    """Per (problem, test): set-hash of the solutions that pass it, plus mean pass."""
    return outcomes.groupBy(P, T).agg(
        *_set_hash(S, F.col("pass")),
        F.count(F.lit(1)).alias("n_solutions"),
    ).withColumn("mean", F.col("n_pass") / F.col("n_solutions"))


def solution_pattern_keys(outcomes: DataFrame) -> DataFrame:
    """Per (problem, solution): set-hash of the tests it passes, plus its pass rate."""
    return outcomes.groupBy(P, S).agg(
        *_set_hash(T, F.col("pass")),
        F.count(F.lit(1)).alias("n_tests"),
    ).withColumn("pass_rate", F.col("n_pass") / F.col("n_tests"))


def test_patterns(outcomes: DataFrame) -> DataFrame:
    """Group the tests of a problem by identical outcome pattern.

    Returns (problem_id, test_id, group_test_id, group_size, mean) where
    ``group_test_id`` is the smallest test id sharing the pattern.  The group
    aggregate is a second map-side-combined aggregate, no window.
    """
    keys = test_pattern_keys(outcomes)
    groups = keys.groupBy(P, "pat_h1", "pat_h2", "n_pass").agg(
        F.min(T).alias("group_test_id"), F.count(F.lit(1)).alias("group_size")
    )
    return keys.join(groups, [P, "pat_h1", "pat_h2", "n_pass"]).select(
        P, T, "group_test_id", "group_size", "mean"
    )


def solution_groups(outcomes: DataFrame, min_size: int = 2) -> DataFrame:
    """Solutions with identical outcome rows; only groups of ``min_size`` or more."""
    keys = solution_pattern_keys(outcomes)
    groups = (
        keys.groupBy(P, "pat_h1", "pat_h2", "n_pass")
        .agg(F.min(S).alias("group_solution_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= min_size)
    )
    return keys.join(groups, [P, "pat_h1", "pat_h2", "n_pass"]).select(
        P, S, "group_solution_id", "group_size", "pass_rate"
    )


def outcome_matrix(outcomes: DataFrame, axis: str = "test") -> DataFrame:
    """D3: the dense matrix, one pattern string per row of the chosen axis.

    ``axis='test'`` gives tests x solutions (the reference's matrix),
    ``axis='solution'`` its transpose.  The string is the row itself, so its
    length is the size of the other axis by definition.
    """
    row, col = (T, S) if axis == "test" else (S, T)
    return outcomes.groupBy(P, row).agg(
        F.expr(f"listagg(CASE WHEN pass THEN '1' ELSE '0' END, '') WITHIN GROUP (ORDER BY {col})").alias("pattern")
    )


def status_rollup(solution_status: DataFrame, outcomes: DataFrame, status: str = "status") -> DataFrame:
    """A solution's final status from its raw status and its test outcomes.

    missing status -> ``timeout``; ``pass`` with any failed test -> ``fail``;
    otherwise the raw status.  ``bool_and`` is combined map-side.
    """
    allpass = outcomes.groupBy(P, S).agg(F.bool_and("pass").alias("all_pass"))
    j = solution_status.join(allpass, [P, S], "left")
    final = (
        F.when(F.col(status).isNull(), F.lit("timeout"))
        .when((F.col(status) == "pass") & (F.coalesce(F.col("all_pass"), F.lit(True)) == F.lit(False)), F.lit("fail"))
        .otherwise(F.col(status))
    )
    return j.select(P, S, F.col(status).alias("raw_status"), final.alias("final_status"))


def row_failure_default(items: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Items whose evaluation produced no score get 0.0 and a single failed test."""
    j = items.join(scores, key, "left")
    return j.select(
        *key,
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        F.when(F.col("score").isNull(), F.array(F.lit(False))).otherwise(F.col("test_pass")).alias("test_pass"),
        F.col("score").isNull().alias("defaulted"),
    )
