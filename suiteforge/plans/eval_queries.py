"""Registered queries for the cache / resume layer (M6) and evaluation and
comparison (M7), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import TEST_SEP, fx_outcomes, fx_problems, fx_responses, fx_turns, spread, with_fx, with_text
from ..functions import compare as cmp
from ..functions import salvage as sv
from ..functions import text as tx
from ..operators import cache as ca
from ..operators import evaluate as ev
from ..operators.outcomes import P, S, T
from ..session import read_table
from .registry import register
from .text_queries import SALVAGE_EXPECTED

# fixed texts of the cache fixture (the failure texts follow the stored-error format)
CACHE_ERRORS = [
    "ERROR: Rate limit exceeded after 5 attempts",
    "ERROR: Server error 503 after 5 attempts",
    "ERROR: HTTP 404 - Not Found",
    "ERROR: Timeout after 5 attempts",
    "ERROR: connection reset",
]


def fx_items(spark, sf) -> DataFrame:
    """Problems with their content hash (prompt key)."""
    p = fx_problems(spark, sf)
    return p.select("id", "key", F.sha2(tx.problem_text("question", "starter_code"), 256).alias("hash_id"))


def fx_cache(spark, sf) -> DataFrame:
    """Every third problem cached, every ninth twice (rising seq), every fifteenth an error text."""
    it = fx_items(spark, sf)
    k = F.col("key")
    errs = F.array(*[F.lit(e) for e in CACHE_ERRORS])
    rows = F.array(
        F.when(k % 3 == 0, F.struct(F.concat(F.lit("resp-"), k.cast("string"), F.lit("-1")).alias("response"), F.lit(1).cast("long").alias("seq"))),
        F.when(k % 9 == 0, F.struct(F.concat(F.lit("resp-"), k.cast("string"), F.lit("-2")).alias("response"), F.lit(2).cast("long").alias("seq"))),
        F.when(k % 15 == 0, F.struct(F.element_at(errs, (F.floor(k / 15) % 5 + 1).cast("int")).alias("response"), F.lit(3).cast("long").alias("seq"))),
    )
    return it.select("hash_id", F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select(
        "hash_id", "r.response", "r.seq"
    )


CACHE_SQL = (
    r"""fx_items AS (
  SELECT id, key, sha256(CASE WHEN starter_code IS NOT NULL AND length(starter_code) > 0
                              THEN question || chr(10) || chr(10) || 'Here is the starter code:' || chr(10) || starter_code
                              ELSE question END) AS hash_id
  FROM fx_problems),
fx_cache AS (
  SELECT hash_id, 'resp-' || CAST(key AS VARCHAR) || '-1' AS response, CAST(1 AS BIGINT) AS seq FROM fx_items WHERE key % 3 = 0
  UNION ALL SELECT hash_id, 'resp-' || CAST(key AS VARCHAR) || '-2', CAST(2 AS BIGINT) FROM fx_items WHERE key % 9 = 0
  UNION ALL SELECT hash_id, ["""
    + ", ".join(f"'{e}'" for e in CACHE_ERRORS)
    + r"""][CAST(floor(key / 15) AS BIGINT) % 5 + 1], CAST(3 AS BIGINT) FROM fx_items WHERE key % 15 = 0),
fx_latest AS (
  SELECT hash_id, response, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY seq DESC, response DESC) AS rn FROM fx_cache) WHERE rn = 1),
fx_classed AS (
  SELECT hash_id, response, seq,
         CASE WHEN NOT starts_with(response, 'ERROR:') THEN NULL
              WHEN starts_with(response, 'ERROR: Rate limit') THEN 'rate_limit'
              WHEN starts_with(response, 'ERROR: Server error') THEN 'server'
              WHEN starts_with(response, 'ERROR: HTTP ') THEN 'http'
              WHEN starts_with(response, 'ERROR: Timeout') THEN 'timeout'
              ELSE 'other' END AS error_class
  FROM fx_latest)"""
)


@register("cache_dedup", with_text("SELECT hash_id, response, seq FROM fx_latest", CACHE_SQL))
def q_cache_dedup(spark, sf):
    return ca.latest_responses(fx_cache(spark, sf))


@register("error_class", with_text("SELECT hash_id, response, error_class FROM fx_classed", CACHE_SQL))
def q_error_class(spark, sf):
    return ca.latest_responses(fx_cache(spark, sf)).select("hash_id", "response", ca.error_class("response").alias("error_class"))


@register(
    "cache_attach",
    with_text(
        """SELECT i.id, i.hash_id, c.response, c.seq, c.error_class,
                  (c.response IS NOT NULL AND c.error_class IS NULL) AS cached
           FROM fx_items i LEFT JOIN fx_classed c USING (hash_id)""",
        CACHE_SQL,
    ),
)
def q_cache_attach(spark, sf):
    a = ca.attach_cached(fx_items(spark, sf), fx_cache(spark, sf))
    return a.select("id", "hash_id", "response", "seq", "error_class", "cached")


@register(
    "cache_pending",
    with_text(
        """SELECT i.id, i.hash_id FROM fx_items i
           WHERE NOT EXISTS (SELECT 1 FROM fx_classed c WHERE c.hash_id = i.hash_id AND c.error_class IS NULL)""",
        CACHE_SQL,
    ),
)
def q_cache_pending(spark, sf):
    return ca.pending(fx_items(spark, sf), fx_cache(spark, sf)).select("id", "hash_id")


@register(
    "resume_split",
    with_text(
        """SELECT id, CASE WHEN key % 4 = 1 THEN 'done' ELSE 'todo' END AS status FROM fx_problems"""
    ),
)
def q_resume_split(spark, sf):
    items = fx_problems(spark, sf).select("id", "key")
    done_rows = items.where(F.col("key") % 4 == 1)  # a results table written by an earlier run
    m = ca.mark_done(items, done_rows, "id")
    return m.select("id", F.when(F.col("done"), F.lit("done")).otherwise(F.lit("todo")).alias("status"))


@register(
    "completion_index",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS BIGINT) AS occurrence FROM documents""",
)
def q_completion_index(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return ca.completion_index(d, "text", ["doc_id"]).select("doc_id", "occurrence")


# ---------------------------------------------------------------- M7 comparison


def fx_outputs(spark, sf) -> DataFrame:
    """(case_id, actual, expected) program outputs built from orders."""
    o = spread(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    bumped = F.format_string("%.6f", F.col("o_totalprice") * F.lit(1.0000001))
    expected = F.concat_ws("\n", k, price, c)
    m = F.col("o_orderkey") % 6
    actual = (
        F.when(m == 0, expected)
        .when(m == 1, F.concat(k, F.lit("  \n"), price, F.lit(" \n"), c, F.lit("  ")))
        .when(m == 2, F.concat(k, F.lit("\n\n"), price, F.lit("\n\n"), c, F.lit("\n")))
        .when(m == 3, F.concat_ws("\n", k, bumped, c))
        .when(m == 4, F.concat_ws("\n", c, price, k))
        .otherwise(F.concat_ws("\n", (F.col("o_orderkey") + 1).cast("string"), price, c))
    )
    return o.select(F.col("o_orderkey").alias("case_id"), actual.alias("actual"), expected.alias("expected"))


LADDER_SQL = r"""
WITH o AS (
  SELECT o_orderkey AS case_id,
         CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c,
         printf('%.2f', o_totalprice) AS price, printf('%.6f', o_totalprice * 1.0000001) AS bumped, o_orderkey % 6 AS m
  FROM orders),
x AS (
  SELECT case_id, k || chr(10) || price || chr(10) || c AS expected,
         CASE m WHEN 0 THEN k || chr(10) || price || chr(10) || c
                WHEN 1 THEN k || '  ' || chr(10) || price || ' ' || chr(10) || c || '  '
                WHEN 2 THEN k || chr(10) || chr(10) || price || chr(10) || chr(10) || c || chr(10)
                WHEN 3 THEN k || chr(10) || bumped || chr(10) || c
                WHEN 4 THEN c || chr(10) || price || chr(10) || k
                ELSE CAST(case_id + 1 AS VARCHAR) || chr(10) || price || chr(10) || c END AS actual
  FROM o),
y AS (
  SELECT case_id, actual, expected,
         CASE WHEN suffix(actual, chr(10)) THEN list_slice(string_split(actual, chr(10)), 1, len(string_split(actual, chr(10))) - 1)
              ELSE string_split(actual, chr(10)) END AS out
  FROM x),
z AS (
  SELECT case_id, actual, expected, out,
         list_transform(list_filter(string_split(expected, chr(10)), lambda s: length(s) > 0), lambda s: trim(s, ' ' || chr(9) || chr(13))) AS el,
         list_filter(out, lambda s: length(s) > 0) AS onb
  FROM y)
SELECT case_id,
       CASE WHEN trim(array_to_string(out, chr(10)), ' ' || chr(9) || chr(10) || chr(13)) = trim(expected, ' ' || chr(9) || chr(10) || chr(13)) THEN 'exact'
            WHEN trim(array_to_string(list_transform(out, lambda s: trim(s, ' ' || chr(9) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13))
                 = trim(expected, ' ' || chr(9) || chr(10) || chr(13)) THEN 'line_strip'
            WHEN out = [expected] THEN 'exact'
            WHEN out = el THEN 'line_strip'
            WHEN onb = el THEN 'blank_drop'
            WHEN len(onb) = len(el)
                 AND NOT list_bool_and(list_transform(list_zip(onb, el), lambda p: regexp_full_match(p[1], '[0-9]+') AND regexp_full_match(p[2], '[0-9]+')))
                 AND list_bool_and(list_transform(list_zip(onb, el), lambda p: TRY_CAST(trim(p[1]) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(p[2]) AS DOUBLE) IS NOT NULL))
                 AND list_bool_and(list_transform(list_zip(onb, el), lambda p:
                         abs(TRY_CAST(trim(p[1]) AS DOUBLE) - TRY_CAST(trim(p[2]) AS DOUBLE)) <= 1e-8 + 1e-5 * abs(TRY_CAST(trim(p[2]) AS DOUBLE))))
                 THEN 'numeric'
            ELSE 'none' END AS rung,
       regexp_full_match(out[1], '[0-9]+') AS first_int
FROM z
"""


@register("output_compare", LADDER_SQL)
def q_output_compare(spark, sf):
    o = fx_outputs(spark, sf)
    first = F.element_at(tx.split_lines("actual"), 1)
    return cmp.compare_outputs(o, "actual", "expected").select("case_id", "rung", cmp.int_like(first).alias("first_int"))


# JSON values compare like Python objects: numbers by value (69.0 == 69), so the
# oracle drops trailing fractional zeros from the minified text before comparing.
def _jnorm(x: str) -> str:
    return (
        "regexp_replace(regexp_replace(CAST(json(" + x + ") AS VARCHAR), "
        "'(\\.[0-9]*?)0+([^0-9]|$)', '\\1\\2', 'g'), '\\.([^0-9]|$)', '\\1', 'g')"
    )


CALL_SQL = (
    r"""
WITH x AS (
  SELECT event_id, props AS actual,
         CASE event_id % 4 WHEN 0 THEN replace(replace(props, '{', '{ '), ':', ' : ')
                           WHEN 1 THEN '[' || props || ', 1]'
                           WHEN 2 THEN '{"k": ' || CAST(value AS VARCHAR) || '}'
                           ELSE '[]' END AS expected
  FROM events)
SELECT event_id,
       coalesce("""
    + _jnorm("actual")
    + " = "
    + _jnorm("expected")
    + """, false)
       OR (json_type(expected) = 'ARRAY' AND json_array_length(expected) > 0
           AND coalesce("""
    + _jnorm("actual")
    + " = "
    + _jnorm("json_extract(expected, '$[0]')")
    + """, false)) AS matched
FROM x
"""
)


@register("call_compare", CALL_SQL)
def q_call_compare(spark, sf):
    e = read_table(spark, sf, "events")
    m = F.col("event_id") % 4
    expected = (
        F.when(m == 0, F.replace(F.replace("props", F.lit("{"), F.lit("{ ")), F.lit(":"), F.lit(" : ")))
        .when(m == 1, F.concat(F.lit("["), F.col("props"), F.lit(", 1]")))
        .when(m == 2, F.concat(F.lit('{"k": '), F.col("value").cast("string"), F.lit("}")))
        .otherwise(F.lit("[]"))
    )
    return e.select("event_id", cmp.call_result_match(F.col("props"), expected).alias("matched"))


@register("call_compare_values", "SELECT event_id, event_id % 8 NOT IN (3, 5, 7) AS matched FROM events")
def q_call_compare_values(spark, sf):
    """H22 by value: exponents, decimals, booleans, nested lists and objects, first elements; text after a value is no value."""
    n = (F.col("event_id") % 1000).cast("string")
    pairs = [
        ("{n}", "{n}.0"),
        ('{"a": [{n}, true], "b": null}', '{"b":null,"a":[{n}.0,1]}'),
        ("{n}e2", "{n}00"),
        ("[{n}, [1, 2]]", "[{n}, [1, 3]]"),
        ("false", '[0, "x"]'),
        ('"{n}"', "{n}"),
        ('{"a": {"x": {n}}}', '[{"a": {"x": {n}.00}}]'),
        ("{n} and more", "{n}"),
    ]
    actual = expected = F.lit(None).cast("string")
    for k, (a, e) in enumerate(pairs):
        here = F.col("event_id") % 8 == k
        actual, expected = (F.when(here, F.replace(F.lit(x), F.lit("{n}"), n)).otherwise(rest) for x, rest in ((a, actual), (e, expected)))
    rows = read_table(spark, sf, "events").select("event_id", actual.alias("actual"), expected.alias("expected"))
    return rows.select("event_id", cmp.call_result_match("actual", "expected").alias("matched"))


@register(
    "int_keys",
    """SELECT event_id, CAST(user_id % 7 AS INTEGER) AS key, event_type AS val, true AS floats_scalar, true AS floats_list,
              CAST(len(string_split(props, ' ')) AS BIGINT) AS nfiles
       FROM events""",
)
def q_int_keys(spark, sf):
    e = read_table(spark, sf, "events")
    js = F.concat(F.lit('{"'), (F.col("user_id") % 7).cast("string"), F.lit('": "'), F.col("event_type"), F.lit('"}'))
    m = cmp.int_keys(F.from_json(js, "map<string,string>"))
    return e.select(
        "event_id",
        F.element_at(F.map_keys(m), 1).alias("key"),
        F.element_at(F.map_values(m), 1).alias("val"),
        cmp.is_floats(F.col("value").cast("string")).alias("floats_scalar"),
        cmp.is_floats(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), (F.col("value") * 2).cast("string"), F.lit("]"))).alias("floats_list"),
        cmp.file_count(F.split("props", " ")).alias("nfiles"),
    )


@register(
    "route_by_kind",
    """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'assert' ELSE 'io' END AS kind,
              CAST(CASE doc_id % 2 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n_tests FROM documents""",
)
def q_route_by_kind(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    tests = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit('["assert f('), F.col("doc_id").cast("string"), F.lit(') == 1", "assert f(0) == 0"]')),
    ).otherwise(F.concat(F.lit('  {"inputs": ["'), F.col("doc_id").cast("string"), F.lit('"], "outputs": ["1"]}')))
    asserts, io = ev.route_by_kind(d.withColumn("tests", tests), "tests")
    a = asserts.select("doc_id", "kind", F.size(F.from_json("tests", "array<string>")).cast("long").alias("n_tests"))
    b = io.select("doc_id", "kind", F.size(F.from_json("tests", "struct<inputs:array<string>>")["inputs"]).cast("long").alias("n_tests"))
    return a.unionByName(b)


@register(
    "partial_score",
    with_fx(
        """SELECT o.problem_id, o.solution_id,
                  CASE WHEN bool_and(o.pass) THEN 1.0 ELSE coalesce(avg(CASE WHEN p.pos < 10 THEN CAST(o.pass AS INT) END), 0.0) END AS score
           FROM fx_outcomes o
           JOIN (SELECT problem_id, test_id, row_number() OVER (PARTITION BY problem_id ORDER BY test_id) - 1 AS pos
                 FROM (SELECT DISTINCT problem_id, test_id FROM fx_outcomes)) p USING (problem_id, test_id)
           GROUP BY 1, 2"""
    ),
)
def q_partial_score(spark, sf):
    return ev.partial_scores(fx_outcomes(spark, sf), cap=10)


@register(
    "output_scores",
    f"""WITH rungs AS ({LADDER_SQL}),
    cells AS (SELECT case_id // 240 AS problem_id, case_id // 20 % 12 AS solution_id, case_id % 20 AS test_id, rung <> 'none' AS pass FROM rungs),
    pos AS (SELECT problem_id, test_id, row_number() OVER (PARTITION BY problem_id ORDER BY test_id) - 1 AS pos FROM (SELECT DISTINCT problem_id, test_id FROM cells))
    SELECT problem_id, solution_id, CASE WHEN bool_and(pass) THEN 1.0 ELSE coalesce(avg(CASE WHEN pos < 10 THEN CAST(pass AS INT) END), 0.0) END AS score
    FROM cells JOIN pos USING (problem_id, test_id) GROUP BY 1, 2""",
)
def q_output_scores(spark, sf):
    """J6 from outputs to scores: the comparison ladder over a table of outputs gives the cells, the partial rule their scores."""
    compared = cmp.compare_outputs(fx_outputs(spark, sf), "actual", "expected")
    return ev.partial_scores(ev.outcomes_of_rungs(compared.select(
        F.expr("case_id div 240").alias(P), F.expr("case_id div 20 % 12").alias(S), (F.col("case_id") % 20).alias(T), "rung"
    )))


@register(
    "fanout",
    with_text(
        f"""SELECT t.problem_id, t.solution_id, CAST(s.test_id AS BIGINT) AS test_id, s.test_text
           FROM fx_turns t
           JOIN (SELECT doc_id AS problem_id, unnest(range(len(l))) AS test_id, unnest(l) AS test_text
                 FROM (SELECT doc_id, string_split(coalesce(tests_text, 'assert False'), '{TEST_SEP}') AS l FROM fx_expected)) s
           USING (problem_id)""",
        SALVAGE_EXPECTED,
    ),
)
def q_fanout(spark, sf):
    sols = fx_turns(spark, sf, "assistant").select(P, S)  # what the model wrote is a solution
    r = sv.parse_responses(fx_responses(spark, sf).select("doc_id", "response"), "response")
    tests = r.select(
        F.col("doc_id").alias(P),
        F.posexplode(sv.fill_sentinel("tests")).alias(T, "test_text"),
    ).withColumn(T, F.col(T).cast("long"))
    return ev.fanout(sols, tests).select(P, S, T, "test_text")
