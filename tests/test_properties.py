"""Properties: dedup/cap sizes, picks, pass@k monotone, determinism, brute-force triple."""

import itertools

from pyspark.sql import functions as F

from conftest import SF_SMALL
from suiteforge.fixtures import fx_outcomes
from suiteforge.operators import outcomes as oc
from suiteforge.operators import select as sel
from suiteforge.operators import stats as st
from suiteforge.operators import suites as su


def _groups(spark):
    o = fx_outcomes(spark, SF_SMALL)
    pats = oc.test_patterns(o).where(F.col("mean") >= 0.1)
    return o, {(r.problem_id, r.test_id): (r.group_test_id, r.group_size) for r in pats.collect()}


def test_dedup_keeps_one_per_pattern(spark):
    o, groups = _groups(spark)
    kept = [(r.problem_id, r.test_id) for r in su.dedup_tests(o, keep=1).collect()]
    keys = [(p, groups[(p, t)][0]) for p, t in kept]
    assert len(keys) == len(set(keys)) == len({(p, g) for (p, _), (g, _) in groups.items()})


def test_cap_keeps_min_five(spark):
    o, groups = _groups(spark)
    kept = [(r.problem_id, r.test_id) for r in su.dedup_tests(o, keep=5).collect()]
    count = {}
    for p, t in kept:
        count[(p, groups[(p, t)][0])] = count.get((p, groups[(p, t)][0]), 0) + 1
    for (p, t), (g, size) in groups.items():
        assert count[(p, g)] == min(5, size)


def test_picks_distinct_and_bounded(spark):
    o = fx_outcomes(spark, SF_SMALL)
    for picks in (sel.diverse_five(o), sel.similar_five(o)):
        rows = picks.collect()
        per = {}
        for r in rows:
            per.setdefault(r.problem_id, []).append(r)
        for pid, rs in per.items():
            ids = [r.solution_id for r in rs]
            assert len(ids) == len(set(ids)) and len(ids) <= 5
            assert all(r.status == ("ok" if len(ids) == 5 else "insufficient") for r in rs)


def test_pass_at_k_monotone(spark):
    rates = oc.solution_pass_rate(fx_outcomes(spark, SF_SMALL))
    vals = [r.pass_at_k for r in st.pass_at_k(rates).orderBy("k").collect()]
    assert vals == sorted(vals)


def test_unbiased_pass_at_1_is_mean_share(spark):
    rates = oc.solution_pass_rate(fx_outcomes(spark, SF_SMALL))
    p1 = [r.pass_at_k for r in st.pass_at_k_unbiased(rates, ks=(1,)).collect()][0]
    share = rates.groupBy("problem_id").agg(F.avg((F.col("pass_rate") == 1.0).cast("double")).alias("s")).agg(F.avg("s")).first()[0]
    assert abs(p1 - share) < 1e-6


def test_deterministic_across_partitions(spark):
    o = fx_outcomes(spark, SF_SMALL)
    results = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(
            (
                sorted(map(tuple, su.dedup_tests(o, keep=1).collect())),
                sorted(map(tuple, su.dedup_tests(o, keep=5).collect())),
                sorted(map(tuple, sel.diverse_five(o).collect())),
                sorted(map(tuple, sel.similar_five(o).collect())),
            )
        )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_diverse_triple_brute_force(spark):
    o = fx_outcomes(spark, SF_SMALL)
    rows = {}
    for r in o.collect():  # small fixture, test only
        rows.setdefault(r.problem_id, {}).setdefault(r.solution_id, {})[r.test_id] = r["pass"]
    want = {}
    for pid, sols in rows.items():
        rate = {s: sum(v.values()) / len(v) for s, v in sols.items()}
        top = [s for s, _ in sorted(rate.items(), key=lambda x: (-x[1], x[0]))[:2]]
        cand = sorted(s for s in sols if s not in top and 0.4 <= rate[s] < 0.9)
        if len(cand) < 3:
            continue
        def d(a, b):
            return sum(sols[a][t] != sols[b][t] for t in sols[a])
        best = None
        for a, b, c in itertools.combinations(cand, 3):
            key = (min(d(a, b), d(a, c), d(b, c)), d(a, b) + d(a, c) + d(b, c))
            if best is None or key > best[0]:
                best = (key, (a, b, c))
        want[pid] = best[1]
    got = {r.problem_id: (r.a, r.b, r.c) for r in sel.diverse_triple(o).collect()}
    assert got == want


def test_total_distance_equals_pairs(spark):
    o = fx_outcomes(spark, SF_SMALL)
    pairs = sel.pair_hamming(o)
    sym = pairs.select("problem_id", F.col("a").alias("solution_id"), "distance").unionByName(
        pairs.select("problem_id", F.col("b").alias("solution_id"), "distance")
    ).groupBy("problem_id", "solution_id").agg(F.sum("distance").alias("total_distance"))
    a = sorted(map(tuple, sym.collect()))
    b = sorted(map(tuple, sel.total_distance(o).select("problem_id", "solution_id", "total_distance").collect()))
    assert a == b


def test_salted_pairs_equal_plain(spark):
    o = fx_outcomes(spark, SF_SMALL)
    plain = sorted(map(tuple, sel.pair_hamming(o).collect()))
    salted = sorted(map(tuple, sel.pair_hamming(o, chunk=3).collect()))
    assert plain == salted


def test_group_row_index_hot_group(spark):
    from suiteforge.operators.sampling import group_row_index, row_index

    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("g"), F.col("id"))
    got = {(r.g, r.id): r.i for r in group_row_index(df, ["g"], ["id"], partitions=7).collect()}
    for g in ("hot", "cold"):
        ids = sorted(i for (gg, i) in got if gg == g)
        assert [got[(g, i)] for i in ids] == list(range(len(ids)))
    glob = {r.id: r.i for r in row_index(df, ["id"], partitions=5).collect()}
    assert [glob[i] for i in range(3000)] == list(range(3000))


def test_triple_prune_is_exact(spark):
    o = fx_outcomes(spark, SF_SMALL)
    rates = oc.solution_pass_rate(o)
    cand = sel.diverse_candidates(rates, sel.top_two(rates))
    pairs = sel.pair_hamming(o, cand)
    a = sorted(map(tuple, sel.best_triple(pairs, prune=True).collect()))
    b = sorted(map(tuple, sel.best_triple(pairs, prune=False).collect()))
    assert a == b


def test_expand_join_salted_equals_plain(spark):
    o = fx_outcomes(spark, SF_SMALL)
    sols, tests = o.select("problem_id", "solution_id").distinct(), o.select("problem_id", "test_id").distinct()
    plain = sorted(map(tuple, oc.expand_join(sols, tests, ["problem_id"], "solution_id", 10**6).collect()))
    salted = sorted(map(tuple, oc.expand_join(sols, tests, ["problem_id"], "solution_id", 3).select("problem_id", "solution_id", "test_id").collect()))
    assert plain == sorted((p, s, t) for p, s, t in plain) and [tuple(x) for x in plain] == salted


def test_approx_percentiles_close(spark):
    rates = oc.solution_pass_rate(fx_outcomes(spark, SF_SMALL))
    exact = {r.percentile: r.value for r in st.stats_percentiles(rates).collect()}
    approx = {r.percentile: r.value for r in st.stats_percentiles(rates, approx=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[k] - approx[k]) <= 0.1 for k in exact)


def test_shard_ranges_contiguous(spark):
    from suiteforge.operators.sampling import shard_ranges

    df = spark.range(103).withColumnRenamed("id", "k")
    rows = sorted((r.k, r.shard) for r in shard_ranges(df, ["k"], 4).collect())
    per = {}
    for k, s in rows:
        per.setdefault(s, []).append(k)
    assert sorted(per) == [0, 1, 2, 3]
    assert [len(per[s]) for s in range(4)] == [26, 26, 26, 25]
    assert all(max(per[s]) < min(per[s + 1]) for s in range(3))
