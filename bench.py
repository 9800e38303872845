"""Benchmark the headline queries.

Three parts: ``queries`` times whole registered queries (fixture included), as
in earlier rounds; ``operators`` times operators alone over the stored outcome
grid; ``skewed`` times the same over a grid in which one problem holds a third
of all cells.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and forces full execution with the ``noop`` sink
(every row computed, nothing collected).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from suiteforge.fixtures import fx_outcomes  # noqa: E402
from suiteforge.operators import outcomes as oc  # noqa: E402
from suiteforge.operators import select as sel  # noqa: E402
from suiteforge.operators import stats as st  # noqa: E402
from suiteforge.operators import suites as su  # noqa: E402
from suiteforge.plans.catalog import QUERIES  # noqa: E402
from suiteforge.plans.curation import final_curation  # noqa: E402
from suiteforge.session import cut_lineage, local_session  # noqa: E402

HEADLINE = [
    "final_curation",
    "dedup_tests",
    "test_patterns",
    "solution_pass_rate",
    "refiltered_pass_rate",
    "diverse_five",
    "similar_five",
    "pair_hamming",
    "stats_percentiles",
    "pass_at_k",
    "stats_reasons",
    "top_problems",
    "json_salvage",
    "code_blocks",
    "output_compare",
    "cache_attach",
    "fanout",
    "render_matrix",
]


OPERATORS = {
    "solution_pass_rate": oc.solution_pass_rate,
    "dedup_tests": su.dedup_tests,
    "final_curation": final_curation,
    "pass_at_k": lambda o: st.pass_at_k(oc.solution_pass_rate(o)),
    "diverse_five": sel.diverse_five,
    "similar_five": sel.similar_five,
}


def timed(df) -> float:
    t0 = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def skewed(grid):
    """The cells of every third problem as one problem: the same solutions, all their tests."""
    hot = grid.where(F.col("problem_id") % 3 == 0).withColumn("test_id", F.col("problem_id") * 100 + F.col("test_id"))
    rest = grid.where(F.col("problem_id") % 3 != 0)
    return rest.unionByName(oc.complete_grid(hot.withColumn("problem_id", F.lit(-1).cast("long"))))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="suiteforge-bench")
    # warm the JVM (class loading, JIT, codegen caches) on the smallest scale, outside the timings
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    grid = cut_lineage(fx_outcomes(spark, sf_dir))
    alone = {name: timed(lambda f=f: f(grid)) for name, f in OPERATORS.items()}
    hot = cut_lineage(skewed(grid))
    on_hot = {name: timed(lambda f=f: f(hot)) for name, f in OPERATORS.items()}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "operators": alone,
                "skewed": on_hot,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
