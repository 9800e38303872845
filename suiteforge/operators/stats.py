"""The evaluation report (D8-D22, F1, F2, A11) as DataFrames.

Every metric is a global or per-group aggregate that Spark combines map-side;
nothing is collected.  Exact percentiles use ``percentile``, whose buffer is a
map of *distinct* values to counts: pass rates are fractions n_pass/n_tests,
so the buffer is bounded by the number of distinct fractions, not by rows.  Shares of nothing
are null.
Doubles are rounded to 6 places so the report is stable across partitionings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..session import cut_lineage
from .outcomes import P, S

# fixed values of the report
PERCENTILES = (25, 50, 75, 90, 95, 99)
HIST_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # last bin closed at 1.0
EASY, MEDIUM = 0.8, 0.4  # difficulty by best solution: >= 0.8 easy, >= 0.4 medium, else hard
TOP_REASONS, TOP_ERRORS, ERROR_CUT = 10, 5, 100


def _r(c: Column | str, name: str) -> Column:
    return round6(c).alias(name)


def stats_basic(rates: DataFrame) -> DataFrame:
    """Problems, solutions and solutions per problem (floor division)."""
    t = rates.agg(F.countDistinct(P).alias("total_problems"), F.count(F.lit(1)).alias("total_solutions"))
    return t.select(
        "total_problems",
        "total_solutions",
        F.when(F.col("total_problems") > 0, F.floor(F.col("total_solutions") / F.col("total_problems")))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("solutions_per_problem"),
    )


def stats_pass_rate(rates: DataFrame) -> DataFrame:
    """Mean, median, population std, min and max of the pass rate."""
    x = F.col("pass_rate")
    return rates.agg(
        _r(F.avg(x), "mean"),
        _r(F.percentile(x, F.lit(0.5)), "median"),
        _r(F.stddev_pop(x), "std"),
        _r(F.min(x), "min"),
        _r(F.max(x), "max"),
    )


def stats_percentiles(rates: DataFrame, percentiles=PERCENTILES, approx: bool = False) -> DataFrame:
    """Linear-interpolation percentiles (``approx=True`` for a sketch on huge inputs)."""
    fr = [p / 100.0 for p in percentiles]
    if approx:
        agg = F.percentile_approx("pass_rate", fr, 100000)
    else:
        agg = F.percentile(F.col("pass_rate"), F.array(*[F.lit(f) for f in fr]))
    return rates.agg(agg.alias("v")).select(
        F.posexplode("v").alias("i", "value")
    ).select(
        F.element_at(F.array(*[F.lit(p) for p in percentiles]), F.col("i") + 1).cast("long").alias("percentile"),
        _r("value", "value"),
    )


SKETCH_K = 400  # size parameter of a KLL sketch: a rank is off by about 0.7 % of the rows, whatever their number


def rate_sketches(rates: DataFrame, by: Sequence[str] = (), value: str = "pass_rate", k: int = SKETCH_K) -> DataFrame:
    """D9/D10 for huge or growing tables: one mergeable KLL sketch of ``value`` for every ``by`` group (one row without).

    A sketch has a few kilobytes and is combined on the map side; stored beside
    a round's outcomes it answers percentiles of any set of rounds without
    reading their rates again.  A group without values has no sketch.
    """
    return rates.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch for every ``by`` group from the stored sketches of its parts."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """(other columns, n, percentile, value): approximate percentiles of every sketch, and how many values it has seen."""
    others = [c for c in sketches.columns if c != "sketch"]
    asked = F.array(*[F.lit(float(p)) for p in percentiles])
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p / 100.0) for p in percentiles]))
    found = sketches.where(F.kll_sketch_get_n_double("sketch") > 0).select(*others, F.kll_sketch_get_n_double("sketch").alias("n"), F.arrays_zip(asked.alias("percentile"), values.alias("value")).alias("found"))
    return found.select(*others, "n", F.inline("found"))


POWERS = [1 << i for i in range(63)]  # candidate k values 1, 2, 4, ...


def pass_at_k(rates: DataFrame) -> DataFrame:
    """Empirical pass@k -- share of problems with a perfect solution among their first k.

    "First k" is by solution order inside the problem; n is the report's
    solutions-per-problem and k runs 1, 2, 4, ... < n, then n.  A problem's
    first perfect solution is a least id, and its place the number of smaller
    ids: two aggregates, so a problem with a third of all solutions is counted
    by many tasks.  Only the distinct places meet the values of k.
    """
    n = stats_basic(rates).select("solutions_per_problem").scalar()
    first = rates.groupBy(P).agg(F.min(F.when(F.col("pass_rate") == 1.0, F.col(S))).alias("_first"))
    places = rates.join(first, P).groupBy(P).agg(F.sum((F.col(S) < F.col("_first")).cast("int")).alias("fp"))
    solved = places.groupBy("fp").agg(F.count(F.lit(1)).alias("problems"))  # null: no perfect solution
    powers = F.array(*[F.lit(k).cast("long") for k in POWERS])
    below = solved.select("fp", "problems", F.explode(powers).alias("k")).where(F.col("k") < n)
    per_k = below.unionByName(solved.select("fp", "problems", n.cast("long").alias("k")))
    hits = F.sum(F.when(F.col("fp") < F.col("k"), F.col("problems")).otherwise(0))
    return per_k.groupBy("k").agg(_r(hits / F.sum("problems"), "pass_at_k"))


def unbiased_pass_at_k_expr(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k) as a running product; 1.0 when n - c < k."""
    prod = F.aggregate(
        F.sequence(n - c + 1, n),
        F.lit(1.0),
        lambda acc, x: acc * (F.lit(1.0) - k.cast("double") / x.cast("double")),
    )
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k_unbiased(rates: DataFrame, ks=(1, 2, 4, 8, 16)) -> DataFrame:
    """D12 averaged over problems for each k; n and c are counted per problem (ragged n allowed)."""
    per_problem = rates.groupBy(P).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pass_rate") == 1.0).cast("int")).cast("long").alias("c")
    )
    per_k = per_problem.select(P, "n", "c", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k"))
    est = unbiased_pass_at_k_expr(F.col("n"), F.col("c"), F.col("k"))
    return per_k.groupBy("k").agg(_r(F.avg(est), "pass_at_k"))


def stats_quality(rates: DataFrame) -> DataFrame:
    """Perfect / partial / failed solution counts and percents."""
    x = F.col("pass_rate")
    t = rates.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((x == 1.0).cast("int")).cast("long").alias("perfect"),
        F.sum((x == 0.0).cast("int")).cast("long").alias("failed"),
    )
    return t.select(
        "perfect",
        (F.col("total") - F.col("perfect") - F.col("failed")).alias("partial"),
        "failed",
        _r(F.try_divide("perfect", "total") * 100, "perfect_pct"),
        _r(F.try_divide(F.col("total") - F.col("perfect") - F.col("failed"), "total") * 100, "partial_pct"),
        _r(F.try_divide("failed", "total") * 100, "failed_pct"),
    )


def hist_bin(x: Column) -> Column:
    """Bin 0..9 of a value in [0, 1]; edges as in HIST_EDGES, last bin closed."""
    e = HIST_EDGES
    b = F.when((x >= e[-2]) & (x <= e[-1]), F.lit(len(e) - 2))
    for i in range(len(e) - 3, -1, -1):
        b = b.when((x >= e[i]) & (x < e[i + 1]), F.lit(i))
    return b


def stats_histogram(rates: DataFrame) -> DataFrame:
    """10-bin histogram with counts and percent of all solutions (empty bins included)."""
    total = rates.select(F.count(F.lit(1))).scalar()
    counts = rates.groupBy(hist_bin(F.col("pass_rate")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = rates.sparkSession.range(len(HIST_EDGES) - 1).select(F.col("id").cast("int").alias("bin"))
    edges = F.array(*[F.lit(v) for v in HIST_EDGES])
    return bins.join(counts, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"),
        F.element_at(edges, F.col("bin") + 1).alias("lower"),
        F.element_at(edges, F.col("bin") + 2).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        _r(F.try_divide(F.coalesce("n", F.lit(0)), total) * 100, "pct"),
    )


def problem_rates(rates: DataFrame) -> DataFrame:
    """Per problem: mean, best and worst solution pass rate."""
    x = F.col("pass_rate")
    return rates.groupBy(P).agg(F.avg(x).alias("avg_rate"), F.max(x).alias("best"), F.min(x).alias("worst"))


def stats_problem(rates: DataFrame) -> DataFrame:
    """Mean and population std of per-problem mean / best / worst."""
    pr = problem_rates(rates)
    return pr.agg(
        _r(F.avg("avg_rate"), "avg_mean"),
        _r(F.stddev_pop("avg_rate"), "avg_std"),
        _r(F.avg("best"), "best_mean"),
        _r(F.stddev_pop("best"), "best_std"),
        _r(F.avg("worst"), "worst_mean"),
        _r(F.stddev_pop("worst"), "worst_std"),
    )


def stats_difficulty(rates: DataFrame) -> DataFrame:
    """Easy / medium / hard problem counts by best solution."""
    pr = problem_rates(rates)
    b = F.col("best")
    t = pr.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((b >= EASY).cast("int")).cast("long").alias("easy"),
        F.sum(((b >= MEDIUM) & (b < EASY)).cast("int")).cast("long").alias("medium"),
        F.sum((b < MEDIUM).cast("int")).cast("long").alias("hard"),
    )
    return t.select(
        "easy",
        "medium",
        "hard",
        _r(F.try_divide("easy", "total") * 100, "easy_pct"),
        _r(F.try_divide("medium", "total") * 100, "medium_pct"),
        _r(F.try_divide("hard", "total") * 100, "hard_pct"),
    )


def normalize_details(details: DataFrame) -> DataFrame:
    """D17 ingest: bare-boolean outcomes get reason/error/time-limit columns as nulls."""
    cols = details.columns
    out = details
    if "reason" not in cols:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    if "error_message" not in cols:
        out = out.withColumn("error_message", F.lit(None).cast("string"))
    if "time_limit" not in cols:
        out = out.withColumn("time_limit", F.lit(None).cast("double"))
    return out


def stats_tests(details: DataFrame) -> DataFrame:
    """Total, passed, failed test results and the overall pass rate."""
    t = details.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.sum(F.col("pass").cast("int")).cast("long").alias("passed"),
    )
    return _tests(t)


def _tests(totals: DataFrame) -> DataFrame:
    return totals.select(
        "total_tests",
        "passed",
        (F.col("total_tests") - F.col("passed")).alias("failed"),
        _r(F.try_divide("passed", "total_tests"), "pass_rate"),
    )


def stats_test_counts(details: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    """Tests per solution -- mean, population std, min, max (a solution without tests counts 0)."""
    c = details.groupBy(P, S).agg(F.count(F.lit(1)).alias("n"))
    if solutions is not None:
        c = solutions.select(P, S).join(c, [P, S], "left").select(P, S, F.coalesce("n", F.lit(0)).alias("n"))
    return _spread_of_counts(c)


def _spread_of_counts(counts: DataFrame) -> DataFrame:
    return counts.agg(
        _r(F.avg("n"), "mean"), _r(F.stddev_pop("n"), "std"), F.min("n").cast("long").alias("min"),
        F.max("n").cast("long").alias("max"),
    )


def _top_shares(counts: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` keys by count with their percent of all, and that total."""
    total = counts.agg(F.sum("n")).scalar()
    first = counts.orderBy(F.col("n").desc(), F.col(key)).limit(top)
    return first.select(key, "n", _r(F.try_divide("n", total) * 100, "pct"), total.alias("total"))


def _reason() -> Column:
    return F.coalesce("reason", F.lit("unknown"))


def stats_reasons(details: DataFrame, top: int = TOP_REASONS) -> DataFrame:
    """Reason counts (``pass`` included), top k, percent of all test results."""
    counts = normalize_details(details).groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return _top_shares(counts, "reason", top).drop("total")


def short_error(msg: Column, cut: int = ERROR_CUT) -> Column:
    """Message cut to ``cut`` characters plus ``...`` when longer."""
    return F.when(F.length(msg) > cut, F.concat(F.substring(msg, 1, cut), F.lit("..."))).otherwise(msg)


def _error() -> Column:
    """The shortened message; null where a result carries none."""
    return short_error(F.nullif(F.col("error_message"), F.lit("")))


def stats_errors(details: DataFrame, top: int = TOP_ERRORS) -> DataFrame:
    """Top error messages (shortened) with percent of tests that carry an error."""
    counts = normalize_details(details).groupBy(_error().alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return _top_shares(counts.where("error is not null"), "error", top).withColumnRenamed("total", "error_tests")


def stats_timeouts(details: DataFrame) -> DataFrame:
    """Results whose reason contains ``timeout`` (any case)."""
    return _timeouts(normalize_details(details).groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def _timeouts(counts: DataFrame) -> DataFrame:
    hit = F.coalesce(F.lower("reason").contains("timeout"), F.lit(False))
    t = counts.agg(F.sum("n").alias("total"), F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long").alias("timeouts"))
    return t.select("timeouts", _r(F.try_divide("timeouts", "total") * 100, "pct"))


def stats_time_limits(details: DataFrame) -> DataFrame:
    """Distribution of distinct time limits, with the overall mean / std / min / max.

    The summary numbers are scalar subqueries over the distribution; no window
    gathers all limits in one task.
    """
    return _limits(normalize_details(details).groupBy("time_limit").agg(F.count(F.lit(1)).alias("n")))


def _limits(counts: DataFrame) -> DataFrame:
    dist = counts.where(F.col("time_limit").isNotNull())
    n, x = F.col("n"), F.col("time_limit")
    whole = dist.agg(F.struct(F.sum(n).alias("n"), (F.sum(x * n) / F.sum(n)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))).scalar()
    var = dist.agg(F.sum(n * (x - whole["mean"]) ** 2) / F.sum(n)).scalar()
    return dist.select(
        "time_limit",
        "n",
        _r(n / whole["n"] * 100, "pct"),
        _r(whole["mean"], "mean"),
        _r(F.sqrt(var), "std"),
        _r(whole["min"], "min"),
        _r(whole["max"], "max"),
    )


def top_problems(rates: DataFrame, k: int = 5) -> DataFrame:
    """the k easiest and k hardest problems by best pass rate, ties by problem id."""
    pr = problem_rates(rates)
    easy = pr.orderBy(F.col("best").desc(), F.col(P)).limit(k).withColumn("kind", F.lit("easiest"))
    hard = pr.orderBy(F.col("best"), F.col(P)).limit(k).withColumn("kind", F.lit("hardest"))
    w = Window.partitionBy("kind").orderBy(
        F.when(F.col("kind") == "easiest", -F.col("best")).otherwise(F.col("best")), F.col(P)
    )
    return easy.unionByName(hard).select(
        "kind", F.row_number().over(w).cast("long").alias("rank"), P, _r("best", "best"), _r("avg_rate", "avg_rate")
    )


def _long(df: DataFrame, metric: str, key_col: str | None = None) -> DataFrame:
    """One report section as long rows (metric, key, value, n)."""
    ids = [key_col] if key_col else []
    values = [c for c in df.columns if c not in ids]
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        ids or [], values, "field", "value"
    )
    key = F.concat_ws("/", *([F.col(key_col).cast("string")] if key_col else []), F.col("field"))
    return long.select(F.lit(metric).alias("metric"), key.alias("key"), "value", F.lit(None).cast("long").alias("n"))


def outcome_cube(details: DataFrame) -> DataFrame:
    """One pass over the outcomes for all sections of the report: counts by solution, by reason, by error and by time limit.

    One aggregate by grouping sets; ``level`` names the set.  Every set is
    combined on the map side, so the reason that most results share, or the
    problem that most belong to, is a few rows for each task.  The result has a
    row for each solution, distinct reason, shortened error and time limit.
    """
    keys = [P, S, "reason", "error", "time_limit"]
    d = normalize_details(details).select(P, S, _reason().alias("reason"), _error().alias("error"), "time_limit", F.col("pass").cast("int").alias("pass"))
    sets = d.groupingSets([[F.col(P), F.col(S)], [F.col("reason")], [F.col("error")], [F.col("time_limit")]], *[F.col(k) for k in keys])
    cube = sets.agg(
        F.grouping_id().alias("_set"), F.avg("pass").alias("pass_rate"), F.count(F.lit(1)).alias("n"), F.sum("pass").cast("long").alias("n_pass")
    )
    # a bit for each key that is not in the set, the first key's the highest
    level = F.when(F.col("_set") == 0b00111, "solution").when(F.col("_set") == 0b11011, "reason").when(F.col("_set") == 0b11101, "error")
    return cube.select(level.otherwise("time_limit").alias("level"), *keys, "pass_rate", "n", "n_pass")


def report_metrics(rates: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """The whole evaluation report as one long table ``(metric, key, value, n)``.

    With ``details`` the outcomes are read once: :func:`outcome_cube` is stored
    and every section is a small aggregate of it, the pass rates too unless
    ``rates`` are given.  The union has one row per reported number, so writing
    it as a single file (``sources.io.write_report``) is safe.
    """
    cube = None if details is None else cut_lineage(outcome_cube(details))

    def level(name: str) -> DataFrame:
        return cube.where(F.col("level") == name)

    if rates is None:
        rates = level("solution").select(P, S, "pass_rate", F.col("n").alias("n_tests"), "n_pass")
    parts = [
        _long(stats_basic(rates), "basic"),
        _long(stats_pass_rate(rates), "pass_rate"),
        _long(stats_percentiles(rates), "percentile", "percentile"),
        _long(pass_at_k(rates), "pass_at_k", "k"),
        _long(stats_quality(rates), "quality"),
        _long(stats_histogram(rates).drop("lower", "upper"), "histogram", "bin"),
        _long(stats_problem(rates), "problem"),
        _long(stats_difficulty(rates), "difficulty"),
    ]
    if cube is not None:
        reasons = level("reason").select("reason", "n")
        tests = level("reason").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tests"), F.sum("n_pass").alias("passed"))
        parts += [
            _long(_tests(tests), "tests"),
            _long(_spread_of_counts(level("solution")), "tests_per_solution"),
            _long(_top_shares(reasons, "reason", TOP_REASONS).drop("total"), "reasons", "reason"),
            _long(_top_shares(level("error").where("error is not null"), "error", TOP_ERRORS).drop("total"), "errors", "error"),
            _long(_timeouts(reasons), "timeouts"),
            _long(_limits(level("time_limit")).select("time_limit", "n", "pct"), "time_limits", "time_limit"),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
