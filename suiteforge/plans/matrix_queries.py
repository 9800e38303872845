"""Registered queries over the outcome matrix (M0-M4) and their DuckDB oracles.

Spark side: library operators over ``fx_outcomes`` (derived from lineitem).
Oracle side: plain SQL over the same fixture, written the obvious way (string
patterns, self joins) so it checks the set-hash / packed-word shortcuts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx_outcome_details, fx_outcomes, with_fx
from ..operators import outcomes as oc
from ..operators import select as sel
from ..operators import stats as st
from ..operators import suites as su
from ..operators.outcomes import P, S, T
from ..session import cut_lineage
from .curation import final_curation
from .registry import ORACLE, register

SEED = "'42'"

RATES = """fx_rates AS (
  SELECT problem_id, solution_id, avg(CAST(pass AS INT)) AS pass_rate, count(*) AS n_tests,
         CAST(sum(CAST(pass AS INT)) AS BIGINT) AS n_pass
  FROM fx_outcomes GROUP BY 1, 2)"""

TMEAN = """fx_tmean AS (
  SELECT problem_id, test_id, avg(CAST(pass AS INT)) AS mean, count(*) AS n_solutions,
         CAST(sum(CAST(pass AS INT)) AS BIGINT) AS n_pass,
         string_agg(CASE WHEN pass THEN '1' ELSE '0' END, '' ORDER BY solution_id) AS pat
  FROM fx_outcomes GROUP BY 1, 2)"""

# non-weak tests, then at most K per identical pattern by the seeded draw
KEPT = """fx_kept{k} AS (
  SELECT problem_id, test_id FROM (
    SELECT problem_id, test_id, row_number() OVER (PARTITION BY problem_id, pat
           ORDER BY md5(concat_ws('|', {seed}, problem_id, test_id))) AS rn
    FROM fx_tmean WHERE mean >= CAST(0.1 AS DOUBLE)) WHERE rn <= {k})"""

SURV = """fx_surv AS (SELECT problem_id, test_id FROM fx_tmean WHERE mean >= CAST(0.1 AS DOUBLE))"""


def kept_sql(k: int) -> str:
    return KEPT.format(k=k, seed=SEED)


# ---------------------------------------------------------------- M0 / M1


@register("solution_pass_rate", with_fx("SELECT * FROM fx_rates", RATES))
def q_solution_pass_rate(spark, sf):
    return oc.solution_pass_rate(fx_outcomes(spark, sf))


@register(
    "test_diversity",
    with_fx("SELECT problem_id, test_id, mean, n_solutions, n_pass FROM fx_tmean", TMEAN),
)
def q_test_diversity(spark, sf):
    return oc.test_pass_mean(fx_outcomes(spark, sf))


@register(
    "outcome_matrix",
    with_fx(
        "SELECT problem_id, test_id, string_agg(CASE WHEN pass THEN '1' ELSE '0' END, '' ORDER BY solution_id) AS pattern "
        "FROM fx_outcomes GROUP BY 1, 2"
    ),
)
def q_outcome_matrix(spark, sf):
    return oc.outcome_matrix(fx_outcomes(spark, sf), axis="test")


@register(
    "outcome_matrix_t",
    with_fx(
        "SELECT problem_id, solution_id, string_agg(CASE WHEN pass THEN '1' ELSE '0' END, '' ORDER BY test_id) AS pattern "
        "FROM fx_outcomes GROUP BY 1, 2"
    ),
)
def q_outcome_matrix_t(spark, sf):
    return oc.outcome_matrix(fx_outcomes(spark, sf), axis="solution")


@register(
    "test_patterns",
    with_fx(
        """SELECT t.problem_id, t.test_id, g.group_test_id, g.group_size, t.mean
           FROM fx_tmean t JOIN (SELECT problem_id, pat, min(test_id) AS group_test_id, count(*) AS group_size
                                 FROM fx_tmean GROUP BY 1, 2) g USING (problem_id, pat)""",
        TMEAN,
    ),
)
def q_test_patterns(spark, sf):
    return oc.test_patterns(fx_outcomes(spark, sf))


SPAT = """fx_spat AS (
  SELECT problem_id, solution_id, avg(CAST(pass AS INT)) AS pass_rate,
         string_agg(CASE WHEN pass THEN '1' ELSE '0' END, '' ORDER BY test_id) AS pat
  FROM {src} GROUP BY 1, 2)"""


@register(
    "solution_groups",
    with_fx(
        """SELECT s.problem_id, s.solution_id, g.group_solution_id, g.group_size, s.pass_rate
           FROM fx_spat s JOIN (SELECT problem_id, pat, min(solution_id) AS group_solution_id, count(*) AS group_size
                                FROM fx_spat GROUP BY 1, 2 HAVING count(*) >= 2) g USING (problem_id, pat)""",
        SPAT.format(src="fx_outcomes"),
    ),
)
def q_solution_groups(spark, sf):
    return oc.solution_groups(fx_outcomes(spark, sf))


@register(
    "weak_tests",
    with_fx("SELECT problem_id, test_id, mean FROM fx_tmean WHERE mean < CAST(0.1 AS DOUBLE)", TMEAN),
)
def q_weak_tests(spark, sf):
    return su.weak_tests(fx_outcomes(spark, sf))


@register(
    "weak_test_lists",
    with_fx(
        "SELECT problem_id, string_agg(CAST(test_id AS VARCHAR), ',' ORDER BY test_id) AS weak_test_ids "
        "FROM fx_tmean WHERE mean < CAST(0.1 AS DOUBLE) GROUP BY 1",
        TMEAN,
    ),
)
def q_weak_test_lists(spark, sf):
    return su.weak_test_lists(fx_outcomes(spark, sf)).select(
        P, F.array_join(F.col("weak_test_ids").cast("array<string>"), ",").alias("weak_test_ids")
    )


@register(
    "nonempty_problems",
    with_fx(
        "SELECT problem_id, count(*) AS n_surviving FROM fx_surv GROUP BY 1",
        TMEAN,
        SURV,
    ),
)
def q_nonempty_problems(spark, sf):
    o = fx_outcomes(spark, sf)
    kept = su.surviving_tests(o)
    problems = o.select(P).distinct()
    n = kept.groupBy(P).agg(F.count(F.lit(1)).alias("n_surviving"))
    return su.nonempty_problems(problems, kept).join(n, P)


@register(
    "refiltered_pass_rate",
    with_fx(
        """SELECT so.problem_id, so.solution_id, coalesce(r.pass_rate, 0.0) AS pass_rate,
                  coalesce(r.n_tests, 0) AS n_tests, coalesce(r.n_pass, 0) AS n_pass
           FROM (SELECT DISTINCT problem_id, solution_id FROM fx_outcomes) so
           LEFT JOIN (SELECT o.problem_id, o.solution_id, avg(CAST(o.pass AS INT)) AS pass_rate, count(*) AS n_tests,
                             CAST(sum(CAST(o.pass AS INT)) AS BIGINT) AS n_pass
                      FROM fx_outcomes o SEMI JOIN fx_surv s ON o.problem_id = s.problem_id AND o.test_id = s.test_id
                      GROUP BY 1, 2) r
           ON so.problem_id = r.problem_id AND so.solution_id = r.solution_id""",
        TMEAN,
        SURV,
    ),
)
def q_refiltered_pass_rate(spark, sf):
    o = fx_outcomes(spark, sf)
    return su.refiltered_pass_rate(o, su.surviving_tests(o))


@register("dedup_tests", with_fx("SELECT * FROM fx_kept1", TMEAN, kept_sql(1)))
def q_dedup_tests(spark, sf):
    return su.dedup_tests(fx_outcomes(spark, sf), keep=1, seed=42)


@register("cap_tests", with_fx("SELECT * FROM fx_kept5", TMEAN, kept_sql(5)))
def q_cap_tests(spark, sf):
    return su.dedup_tests(fx_outcomes(spark, sf), keep=5, seed=42)


@register(
    "reindex_tests",
    with_fx(
        "SELECT problem_id, test_id, row_number() OVER (PARTITION BY problem_id ORDER BY test_id) - 1 AS new_test_id FROM fx_kept1",
        TMEAN,
        kept_sql(1),
    ),
)
def q_reindex_tests(spark, sf):
    return su.reindex_tests(su.dedup_tests(fx_outcomes(spark, sf), keep=1, seed=42))


@register(
    "min_suite",
    with_fx("SELECT problem_id, count(*) AS n_tests FROM fx_kept5 GROUP BY 1 HAVING count(*) >= 5", TMEAN, kept_sql(5)),
)
def q_min_suite(spark, sf):
    return su.min_suite(su.dedup_tests(fx_outcomes(spark, sf), keep=5, seed=42), 5)


@register(
    "max_perfect",
    with_fx(
        """SELECT problem_id, CAST(sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_perfect
           FROM (SELECT o.problem_id, o.solution_id, avg(CAST(o.pass AS INT)) AS pass_rate
                 FROM fx_outcomes o SEMI JOIN fx_kept5 k ON o.problem_id = k.problem_id AND o.test_id = k.test_id
                 GROUP BY 1, 2)
           GROUP BY 1 HAVING sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) <= 8""",
        TMEAN,
        kept_sql(5),
    ),
)
def q_max_perfect(spark, sf):
    o = fx_outcomes(spark, sf)
    kept = su.dedup_tests(o, keep=5, seed=42)
    return su.max_perfect(oc.solution_pass_rate(su.keep_outcomes(o, kept)), 8)


@register(
    "final_curation",
    with_fx(
        """SELECT k.problem_id, k.test_id,
                  row_number() OVER (PARTITION BY k.problem_id ORDER BY k.test_id) - 1 AS new_test_id,
                  n.n_tests, p.n_perfect
           FROM fx_kept5 k
           JOIN (SELECT problem_id, count(*) AS n_tests FROM fx_kept5 GROUP BY 1 HAVING count(*) >= 5) n USING (problem_id)
           JOIN (SELECT problem_id, CAST(sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_perfect
                 FROM (SELECT o.problem_id, o.solution_id, avg(CAST(o.pass AS INT)) AS pass_rate
                       FROM fx_outcomes o SEMI JOIN fx_kept5 k ON o.problem_id = k.problem_id AND o.test_id = k.test_id
                       GROUP BY 1, 2)
                 GROUP BY 1 HAVING sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) <= 8) p USING (problem_id)""",
        TMEAN,
        kept_sql(5),
    ),
)
def q_final_curation(spark, sf):
    return final_curation(fx_outcomes(spark, sf), min_tests=5, max_perfect_solutions=8, cap=5, seed=42)


@register(
    "binary_score",
    with_fx(
        "SELECT problem_id, solution_id, pass_rate, n_tests, n_pass, CASE WHEN pass_rate = 1.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM fx_rates",
        RATES,
    ),
)
def q_binary_score(spark, sf):
    return oc.binary_score(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register("unexecuted_fill", with_fx("SELECT * FROM fx_outcomes"))
def q_unexecuted_fill(spark, sf):
    return fx_outcomes(spark, sf)


def _raw_status(col):
    m = col % 4
    return F.when(m == 0, F.lit(None).cast("string")).when(m == 3, F.lit("syntax_error")).otherwise(F.lit("pass"))


@register(
    "status_rollup",
    with_fx(
        """SELECT s.problem_id, s.solution_id, s.raw_status,
                  CASE WHEN s.raw_status IS NULL THEN 'timeout'
                       WHEN s.raw_status = 'pass' AND NOT coalesce(a.all_pass, true) THEN 'fail'
                       ELSE s.raw_status END AS final_status
           FROM (SELECT DISTINCT problem_id, solution_id,
                        CASE WHEN solution_id % 4 = 0 THEN NULL WHEN solution_id % 4 = 3 THEN 'syntax_error' ELSE 'pass' END AS raw_status
                 FROM fx_outcomes) s
           LEFT JOIN (SELECT problem_id, solution_id, bool_and(pass) AS all_pass FROM fx_outcomes GROUP BY 1, 2) a
           ON s.problem_id = a.problem_id AND s.solution_id = a.solution_id"""
    ),
)
def q_status_rollup(spark, sf):
    o = fx_outcomes(spark, sf)
    status = o.select(P, S).distinct().withColumn("status", _raw_status(F.col(S)))
    return oc.status_rollup(status, o)


# ---------------------------------------------------------------- M3 selection

PAIRS = """fx_pairs AS (
  SELECT a.problem_id, a.solution_id AS a, b.solution_id AS b,
         CAST(sum(CASE WHEN a.pass <> b.pass THEN 1 ELSE 0 END) AS BIGINT) AS distance
  FROM {src} a JOIN {src} b ON a.problem_id = b.problem_id AND a.test_id = b.test_id AND a.solution_id < b.solution_id
  GROUP BY 1, 2, 3)"""

TOP2 = """fx_top2 AS (
  SELECT problem_id, solution_id, pass_rate, rank FROM (
    SELECT problem_id, solution_id, pass_rate,
           row_number() OVER (PARTITION BY problem_id ORDER BY pass_rate DESC, solution_id) AS rank FROM {rates})
  WHERE rank <= 2)"""

CAND = """fx_cand AS (
  SELECT r.problem_id, r.solution_id FROM {rates} r ANTI JOIN fx_top2 t USING (problem_id, solution_id)
  WHERE r.pass_rate >= CAST(0.4 AS DOUBLE) AND r.pass_rate < CAST(0.9 AS DOUBLE))"""

TRIPLE = """fx_triple AS (
  SELECT problem_id, a, b, c, min_distance, total_distance FROM (
    SELECT ab.problem_id, ab.a, ab.b, ac.b AS c,
           least(ab.distance, ac.distance, bc.distance) AS min_distance,
           ab.distance + ac.distance + bc.distance AS total_distance,
           row_number() OVER (PARTITION BY ab.problem_id
                              ORDER BY least(ab.distance, ac.distance, bc.distance) DESC,
                                       ab.distance + ac.distance + bc.distance DESC, ab.a, ab.b, ac.b) AS rn
    FROM fx_cpairs ab
    JOIN fx_cpairs ac ON ab.problem_id = ac.problem_id AND ab.a = ac.a AND ab.b < ac.b
    JOIN fx_cpairs bc ON bc.problem_id = ab.problem_id AND bc.a = ab.b AND bc.b = ac.b)
  WHERE rn = 1)"""

CPAIRS = """fx_cpairs AS (
  SELECT p.* FROM fx_pairs p
  SEMI JOIN fx_cand x ON p.problem_id = x.problem_id AND p.a = x.solution_id
  SEMI JOIN fx_cand y ON p.problem_id = y.problem_id AND p.b = y.solution_id)"""


@register("pair_hamming", with_fx("SELECT * FROM fx_pairs", PAIRS.format(src="fx_outcomes")))
def q_pair_hamming(spark, sf):
    return sel.pair_hamming(fx_outcomes(spark, sf))


@register(
    "top_two",
    with_fx("SELECT * FROM fx_top2", RATES, TOP2.format(rates="fx_rates")),
)
def q_top_two(spark, sf):
    return sel.top_two(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "diverse_triple",
    with_fx(
        "SELECT * FROM fx_triple",
        RATES,
        TOP2.format(rates="fx_rates"),
        CAND.format(rates="fx_rates"),
        PAIRS.format(src="fx_outcomes"),
        CPAIRS,
        TRIPLE,
    ),
)
def q_diverse_triple(spark, sf):
    return sel.diverse_triple(fx_outcomes(spark, sf))


SURV_OUT = """fx_sv AS (
  SELECT o.* FROM fx_outcomes o SEMI JOIN fx_surv s ON o.problem_id = s.problem_id AND o.test_id = s.test_id)"""
SO_RATES = """fx_sorates AS (
  SELECT problem_id, solution_id, avg(CAST(pass AS INT)) AS pass_rate FROM fx_sv GROUP BY 1, 2)"""

FINISH = """SELECT problem_id, solution_id, '{kind}' AS kind,
       row_number() OVER (PARTITION BY problem_id ORDER BY solution_id) - 1 AS slot,
       CASE WHEN count(*) OVER (PARTITION BY problem_id) >= 5 THEN 'ok' ELSE 'insufficient' END AS status
FROM fx_picks"""


@register(
    "diverse_five",
    with_fx(
        FINISH.format(kind="diverse"),
        TMEAN,
        SURV,
        SURV_OUT,
        SO_RATES,
        TOP2.format(rates="fx_sorates"),
        CAND.format(rates="fx_sorates"),
        PAIRS.format(src="fx_sv"),
        """fx_many AS (SELECT problem_id FROM fx_cand GROUP BY 1 HAVING count(*) >= 3)""",
        CPAIRS.replace("FROM fx_pairs p", "FROM fx_pairs p SEMI JOIN fx_many m ON p.problem_id = m.problem_id"),
        TRIPLE,
        """fx_extra AS (
          SELECT problem_id, solution_id FROM (
            SELECT r.problem_id, r.solution_id,
                   row_number() OVER (PARTITION BY r.problem_id ORDER BY md5(concat_ws('|', '42', r.problem_id, r.solution_id))) AS rn
            FROM fx_sorates r ANTI JOIN fx_top2 t USING (problem_id, solution_id)
            WHERE r.pass_rate > CAST(0.1 AS DOUBLE) AND r.problem_id NOT IN (SELECT problem_id FROM fx_many))
          WHERE rn <= 3)""",
        """fx_picks AS (
          SELECT problem_id, solution_id FROM fx_top2
          UNION ALL SELECT problem_id, a FROM fx_triple
          UNION ALL SELECT problem_id, b FROM fx_triple
          UNION ALL SELECT problem_id, c FROM fx_triple
          UNION ALL SELECT problem_id, solution_id FROM fx_extra)""",
    ),
)
def q_diverse_five(spark, sf):
    o = fx_outcomes(spark, sf)
    return sel.diverse_five(cut_lineage(su.keep_outcomes(o, su.surviving_tests(o))), seed=42)


TOTAL = """fx_total AS (
  SELECT a.problem_id, a.solution_id, CAST(sum(CASE WHEN a.pass <> b.pass THEN 1 ELSE 0 END) AS BIGINT) AS total_distance
  FROM {src} a JOIN {src} b ON a.problem_id = b.problem_id AND a.test_id = b.test_id AND a.solution_id <> b.solution_id
  GROUP BY 1, 2)"""


@register(
    "closest_five",
    with_fx(
        """SELECT problem_id, solution_id, total_distance FROM (
             SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY total_distance, solution_id) AS rn FROM fx_total)
           WHERE rn <= 5""",
        TOTAL.format(src="fx_outcomes"),
    ),
)
def q_closest_five(spark, sf):
    return sel.closest_five(fx_outcomes(spark, sf))


@register(
    "total_distance",
    with_fx("SELECT * FROM fx_total", TOTAL.format(src="fx_outcomes")),
)
def q_total_distance(spark, sf):
    return sel.total_distance(fx_outcomes(spark, sf))


@register(
    "nearest_fill",
    with_fx(
        """SELECT problem_id, solution_id, min(d) AS min_distance FROM (
             SELECT a.problem_id, a.solution_id, s.solution_id AS seed_id,
                    CAST(sum(CASE WHEN a.pass <> b.pass THEN 1 ELSE 0 END) AS BIGINT) AS d
             FROM fx_outcomes a
             JOIN fx_top2 s ON a.problem_id = s.problem_id
             JOIN fx_outcomes b ON b.problem_id = s.problem_id AND b.solution_id = s.solution_id AND b.test_id = a.test_id
             WHERE a.solution_id NOT IN (SELECT solution_id FROM fx_top2 t WHERE t.problem_id = a.problem_id)
             GROUP BY 1, 2, 3)
           GROUP BY 1, 2""",
        RATES,
        TOP2.format(rates="fx_rates"),
    ),
)
def q_nearest_fill(spark, sf):
    o = fx_outcomes(spark, sf)
    seeds = sel.top_two(oc.solution_pass_rate(o))
    return sel.nearest_distance(o, seeds)


@register(
    "similar_five",
    with_fx(
        FINISH.format(kind="similar"),
        TMEAN,
        kept_sql(1),
        """fx_do AS (
          SELECT o.* FROM fx_outcomes o SEMI JOIN fx_kept1 k ON o.problem_id = k.problem_id AND o.test_id = k.test_id)""",
        SPAT.format(src="fx_do"),
        """fx_gs AS (SELECT problem_id, pat, count(*) AS gsize FROM fx_spat GROUP BY 1, 2)""",
        """fx_chosen AS (
          SELECT s.problem_id,
                 arg_min(s.pat, md5(concat_ws('|', '42', s.problem_id, s.solution_id))) AS pat,
                 arg_min(g.gsize, md5(concat_ws('|', '42', s.problem_id, s.solution_id))) AS gsize
          FROM fx_spat s JOIN fx_gs g USING (problem_id, pat) WHERE g.gsize > 1 GROUP BY 1)""",
        """fx_members AS (SELECT s.problem_id, s.solution_id, c.gsize FROM fx_spat s JOIN fx_chosen c USING (problem_id, pat))""",
        """fx_big AS (
          SELECT problem_id, solution_id FROM (
            SELECT problem_id, solution_id,
                   row_number() OVER (PARTITION BY problem_id ORDER BY md5(concat_ws('|', '43', problem_id, solution_id))) AS rn
            FROM fx_members WHERE gsize >= 5) WHERE rn <= 5)""",
        """fx_small AS (SELECT * FROM fx_members WHERE gsize < 5)""",
        """fx_nd AS (
          SELECT problem_id, solution_id, min(d) AS min_distance FROM (
            SELECT a.problem_id, a.solution_id, s.solution_id AS seed_id,
                   sum(CASE WHEN a.pass <> b.pass THEN 1 ELSE 0 END) AS d
            FROM fx_do a
            JOIN fx_small s ON a.problem_id = s.problem_id
            JOIN fx_do b ON b.problem_id = s.problem_id AND b.solution_id = s.solution_id AND b.test_id = a.test_id
            WHERE NOT EXISTS (SELECT 1 FROM fx_small z WHERE z.problem_id = a.problem_id AND z.solution_id = a.solution_id)
            GROUP BY 1, 2, 3)
          GROUP BY 1, 2)""",
        """fx_fill AS (
          SELECT problem_id, solution_id FROM (
            SELECT n.problem_id, n.solution_id, g.gsize,
                   row_number() OVER (PARTITION BY n.problem_id
                                      ORDER BY n.min_distance, md5(concat_ws('|', '44', n.problem_id, n.solution_id))) AS rn
            FROM fx_nd n JOIN (SELECT DISTINCT problem_id, gsize FROM fx_small) g USING (problem_id))
          WHERE rn <= 5 - gsize)""",
        TOTAL.format(src="fx_do"),
        """fx_closest AS (
          SELECT problem_id, solution_id FROM (
            SELECT t.*, row_number() OVER (PARTITION BY problem_id ORDER BY total_distance, solution_id) AS rn
            FROM fx_total t WHERE problem_id NOT IN (SELECT problem_id FROM fx_chosen))
          WHERE rn <= 5)""",
        """fx_picks AS (
          SELECT problem_id, solution_id FROM fx_big
          UNION ALL SELECT problem_id, solution_id FROM fx_small
          UNION ALL SELECT problem_id, solution_id FROM fx_fill
          UNION ALL SELECT problem_id, solution_id FROM fx_closest)""",
    ),
)
def q_similar_five(spark, sf):
    o = fx_outcomes(spark, sf)
    return sel.similar_five(cut_lineage(su.keep_outcomes(o, su.dedup_tests(o, keep=1, seed=42))), seed=42)


# ---------------------------------------------------------------- M4 report

R = "round({x}, 6)"


@register(
    "stats_basic",
    with_fx(
        """SELECT count(DISTINCT problem_id) AS total_problems, count(*) AS total_solutions,
                  CAST(CASE WHEN count(DISTINCT problem_id) > 0 THEN floor(count(*) / count(DISTINCT problem_id)) ELSE 0 END AS BIGINT)
                  AS solutions_per_problem FROM fx_rates""",
        RATES,
    ),
)
def q_stats_basic(spark, sf):
    return st.stats_basic(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "stats_pass_rate",
    with_fx(
        """SELECT round(avg(pass_rate), 6) AS mean, round(quantile_cont(pass_rate, 0.5), 6) AS median,
                  round(stddev_pop(pass_rate), 6) AS std, round(min(pass_rate), 6) AS min, round(max(pass_rate), 6) AS max
           FROM fx_rates""",
        RATES,
    ),
)
def q_stats_pass_rate(spark, sf):
    return st.stats_pass_rate(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "stats_percentiles",
    with_fx(
        " UNION ALL ".join(
            f"SELECT CAST({p} AS BIGINT) AS percentile, round(quantile_cont(pass_rate, {p / 100.0}), 6) AS value FROM fx_rates"
            for p in st.PERCENTILES
        ),
        RATES,
    ),
)
def q_stats_percentiles(spark, sf):
    return st.stats_percentiles(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "pass_at_k",
    with_fx(
        """SELECT k, round(avg(CASE WHEN fp IS NOT NULL AND fp < k THEN 1 ELSE 0 END), 6) AS pass_at_k
           FROM fx_fp, fx_ks GROUP BY k""",
        RATES,
        """fx_n AS (SELECT CAST(floor(count(*) / count(DISTINCT problem_id)) AS BIGINT) AS n FROM fx_rates)""",
        """fx_ks AS (SELECT CAST(pow(2, i) AS BIGINT) AS k FROM range(0, 62) t(i), fx_n WHERE pow(2, i) < fx_n.n
                     UNION SELECT n FROM fx_n)""",
        """fx_fp AS (
          SELECT problem_id, min(CASE WHEN pass_rate = 1.0 THEN idx END) AS fp FROM (
            SELECT problem_id, pass_rate, row_number() OVER (PARTITION BY problem_id ORDER BY solution_id) - 1 AS idx FROM fx_rates)
          GROUP BY 1)""",
    ),
)
def q_pass_at_k(spark, sf):
    return st.pass_at_k(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "pass_at_k_unbiased",
    with_fx(
        """SELECT k, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
                                    ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda x: 1.0 - k / x), lambda p, q: p * q)
                               END), 6) AS pass_at_k
           FROM (SELECT problem_id, count(*) AS n, CAST(sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS c
                 FROM fx_rates GROUP BY 1) pp,
                (SELECT CAST(unnest([1, 2, 4, 8, 16]) AS BIGINT) AS k) ks
           GROUP BY k""",
        RATES,
    ),
)
def q_pass_at_k_unbiased(spark, sf):
    return st.pass_at_k_unbiased(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "stats_quality",
    with_fx(
        """SELECT perfect, total - perfect - failed AS partial, failed,
                  round(perfect / total * 100, 6) AS perfect_pct,
                  round((total - perfect - failed) / total * 100, 6) AS partial_pct,
                  round(failed / total * 100, 6) AS failed_pct
           FROM (SELECT count(*) AS total,
                        CAST(sum(CASE WHEN pass_rate = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS perfect,
                        CAST(sum(CASE WHEN pass_rate = 0.0 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM fx_rates)""",
        RATES,
    ),
)
def q_stats_quality(spark, sf):
    return st.stats_quality(oc.solution_pass_rate(fx_outcomes(spark, sf)))


def _hist_case(x: str) -> str:
    e = st.HIST_EDGES
    parts = [f"WHEN {x} >= {e[i]} AND {x} < {e[i + 1]} THEN {i}" for i in range(len(e) - 2)]
    parts.append(f"WHEN {x} >= {e[-2]} AND {x} <= {e[-1]} THEN {len(e) - 2}")
    return "CASE " + " ".join(parts) + " END"


@register(
    "stats_histogram",
    with_fx(
        f"""SELECT CAST(b.bin AS BIGINT) AS bin, CAST(b.bin AS DOUBLE) / 10 AS lower, CAST(b.bin + 1 AS DOUBLE) / 10 AS upper,
                   coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (SELECT count(*) FROM fx_rates) * 100, 6) AS pct
            FROM range(0, 10) b(bin)
            LEFT JOIN (SELECT {_hist_case('pass_rate')} AS bin, count(*) AS n FROM fx_rates GROUP BY 1) c ON b.bin = c.bin""",
        RATES,
    ),
)
def q_stats_histogram(spark, sf):
    return st.stats_histogram(oc.solution_pass_rate(fx_outcomes(spark, sf)))


PR = """fx_pr AS (SELECT problem_id, avg(pass_rate) AS avg_rate, max(pass_rate) AS best, min(pass_rate) AS worst
                  FROM fx_rates GROUP BY 1)"""


@register(
    "stats_problem",
    with_fx(
        """SELECT round(avg(avg_rate), 6) AS avg_mean, round(stddev_pop(avg_rate), 6) AS avg_std,
                  round(avg(best), 6) AS best_mean, round(stddev_pop(best), 6) AS best_std,
                  round(avg(worst), 6) AS worst_mean, round(stddev_pop(worst), 6) AS worst_std FROM fx_pr""",
        RATES,
        PR,
    ),
)
def q_stats_problem(spark, sf):
    return st.stats_problem(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "stats_difficulty",
    with_fx(
        """SELECT easy, medium, hard, round(easy / total * 100, 6) AS easy_pct, round(medium / total * 100, 6) AS medium_pct,
                  round(hard / total * 100, 6) AS hard_pct
           FROM (SELECT count(*) AS total,
                        CAST(sum(CASE WHEN best >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS easy,
                        CAST(sum(CASE WHEN best >= 0.4 AND best < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
                        CAST(sum(CASE WHEN best < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS hard FROM fx_pr)""",
        RATES,
        PR,
    ),
)
def q_stats_difficulty(spark, sf):
    return st.stats_difficulty(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "top_problems",
    with_fx(
        """SELECT kind, rank, problem_id, round(best, 6) AS best, round(avg_rate, 6) AS avg_rate FROM (
             SELECT 'easiest' AS kind, row_number() OVER (ORDER BY best DESC, problem_id) AS rank, * FROM fx_pr
             UNION ALL
             SELECT 'hardest' AS kind, row_number() OVER (ORDER BY best, problem_id) AS rank, * FROM fx_pr)
           WHERE rank <= 5""",
        RATES,
        PR,
    ),
)
def q_top_problems(spark, sf):
    return st.top_problems(oc.solution_pass_rate(fx_outcomes(spark, sf)))


@register(
    "stats_tests",
    with_fx(
        """SELECT total_tests, passed, total_tests - passed AS failed, round(passed / total_tests, 6) AS pass_rate
           FROM (SELECT count(*) AS total_tests, CAST(sum(CAST(pass AS INT)) AS BIGINT) AS passed FROM fx_details)"""
    ),
)
def q_stats_tests(spark, sf):
    return st.stats_tests(fx_outcome_details(spark, sf))


@register(
    "stats_test_counts",
    with_fx(
        """SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max
           FROM (SELECT problem_id, solution_id, count(*) AS n FROM fx_details GROUP BY 1, 2)"""
    ),
)
def q_stats_test_counts(spark, sf):
    return st.stats_test_counts(fx_outcome_details(spark, sf))


@register(
    "stats_reasons",
    with_fx(
        """SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM fx_details) * 100, 6) AS pct
           FROM fx_details GROUP BY reason ORDER BY n DESC, reason LIMIT 10"""
    ),
)
def q_stats_reasons(spark, sf):
    return st.stats_reasons(fx_outcome_details(spark, sf))


@register(
    "stats_errors",
    with_fx(
        """SELECT error, count(*) AS n,
                  round(count(*) / (SELECT count(*) FROM fx_details WHERE error_message IS NOT NULL AND error_message <> '') * 100, 6) AS pct,
                  (SELECT count(*) FROM fx_details WHERE error_message IS NOT NULL AND error_message <> '') AS error_tests
           FROM (SELECT CASE WHEN length(error_message) > 100 THEN concat(left(error_message, 100), '...') ELSE error_message END AS error
                 FROM fx_details WHERE error_message IS NOT NULL AND error_message <> '')
           GROUP BY error ORDER BY n DESC, error LIMIT 5"""
    ),
)
def q_stats_errors(spark, sf):
    return st.stats_errors(fx_outcome_details(spark, sf))


@register(
    "stats_timeouts",
    with_fx(
        """SELECT CAST(sum(CASE WHEN lower(reason) LIKE '%timeout%' THEN 1 ELSE 0 END) AS BIGINT) AS timeouts,
                  round(sum(CASE WHEN lower(reason) LIKE '%timeout%' THEN 1 ELSE 0 END) / count(*) * 100, 6) AS pct
           FROM fx_details"""
    ),
)
def q_stats_timeouts(spark, sf):
    return st.stats_timeouts(fx_outcome_details(spark, sf))


@register(
    "stats_time_limits",
    with_fx(
        """SELECT time_limit, count(*) AS n, round(count(*) / (SELECT count(*) FROM fx_details) * 100, 6) AS pct,
                  (SELECT round(avg(time_limit), 6) FROM fx_details) AS mean,
                  (SELECT round(stddev_pop(time_limit), 6) FROM fx_details) AS std,
                  (SELECT round(min(time_limit), 6) FROM fx_details) AS min,
                  (SELECT round(max(time_limit), 6) FROM fx_details) AS max
           FROM fx_details GROUP BY time_limit"""
    ),
)
def q_stats_time_limits(spark, sf):
    return st.stats_time_limits(fx_outcome_details(spark, sf))


#: Sections of the report: metric, the query whose numbers it holds, its key column, its fields.
REPORT = (
    ("basic", "stats_basic", None, "total_problems total_solutions solutions_per_problem"),
    ("pass_rate", "stats_pass_rate", None, "mean median std min max"),
    ("percentile", "stats_percentiles", "percentile", "value"),
    ("pass_at_k", "pass_at_k", "k", "pass_at_k"),
    ("quality", "stats_quality", None, "perfect partial failed perfect_pct partial_pct failed_pct"),
    ("histogram", "stats_histogram", "bin", "n pct"),
    ("problem", "stats_problem", None, "avg_mean avg_std best_mean best_std worst_mean worst_std"),
    ("difficulty", "stats_difficulty", None, "easy medium hard easy_pct medium_pct hard_pct"),
    ("tests", "stats_tests", None, "total_tests passed failed pass_rate"),
    ("tests_per_solution", "stats_test_counts", None, "mean std min max"),
    ("reasons", "stats_reasons", "reason", "n pct"),
    ("errors", "stats_errors", "error", "n pct"),
    ("timeouts", "stats_timeouts", None, "timeouts pct"),
    ("time_limits", "stats_time_limits", "time_limit", "n pct"),
)


def _report_sql() -> str:
    """The report as the union of its sections' own SQL, each over all outcomes."""
    parts = []
    for metric, query, key, fields in REPORT:
        name = "" if key is None else f"CAST({key} AS VARCHAR) || '/' || "
        rows = ", ".join(f"{{'key': {name}'{f}', 'value': CAST({f} AS DOUBLE)}}" for f in fields.split())
        parts.append(f"SELECT '{metric}' AS metric, x.key AS key, x.value AS value FROM (SELECT unnest([{rows}]) AS x FROM ({ORACLE[query]}))")
    return "\nUNION ALL ".join(parts)


@register("report_metrics", _report_sql())
def q_report_metrics(spark, sf):
    return st.report_metrics(details=fx_outcome_details(spark, sf)).drop("n")


@register(
    "suite_audit",
    with_fx(
        """SELECT round(avg_before, 6) AS avg_before, round(avg_after, 6) AS avg_after,
                  round(avg_before - avg_after, 6) AS avg_removed,
                  round((avg_before - avg_after) / avg_before * 100, 6) AS pct_removed,
                  problems_before, problems_after, problems_before - problems_after AS problems_removed
           FROM (SELECT avg(nb) AS avg_before, avg(na) AS avg_after, count(nb) AS problems_before, count(na) AS problems_after
                 FROM (SELECT problem_id, count(*) AS nb FROM fx_tmean GROUP BY 1) b
                 FULL JOIN (SELECT problem_id, count(*) AS na FROM fx_kept5 GROUP BY 1) a USING (problem_id))""",
        TMEAN,
        kept_sql(5),
    ),
)
def q_suite_audit(spark, sf):
    o = fx_outcomes(spark, sf)
    return su.suite_audit(o.select(P, T).distinct(), su.dedup_tests(o, keep=5, seed=42))
