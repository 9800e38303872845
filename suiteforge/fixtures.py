"""Derived fixtures, all computed by Spark from the driver tables.

Each ``fx_*`` function has a DuckDB twin in ``FX_SQL`` so the oracle side can
build the same input from the same parquet views.  The rules are stated in
FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import round6_sql
from .operators.outcomes import complete_grid
from .session import cut_lineage, read_table


def fx_raw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed cells (problem, solution, test, pass) before grid completion."""
    li = read_table(spark, sf_dir, "lineitem")
    cells = li.groupBy(
        F.floor(F.col("l_partkey") / 40).cast("long").alias("problem_id"),
        ((F.col("l_suppkey") + F.col("l_linenumber")) % 16).cast("long").alias("solution_id"),
        (F.col("l_orderkey") % 20).cast("long").alias("test_id"),
    ).agg(F.sum("l_quantity").alias("q"))
    pm = F.col("problem_id") % 5
    tm = F.col("test_id") % 8
    threshold = (
        F.when((pm == 3) | (tm == 0) | ((pm == 4) & (F.col("test_id") > 3)), F.lit(400))
        .when((pm == 0) | tm.isin(1, 2), F.lit(0))
        .otherwise(12 * tm + 6 * (F.col("solution_id") % 6))
    )
    return cells.select("problem_id", "solution_id", "test_id", (F.col("q") >= threshold).alias("pass"))


def fx_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete grid: (problem_id, solution_id, test_id, pass, reason).

    Materialised once (reliable checkpoint in the shared checkpoint folder),
    like the stored outcome table of a real run: every query then reads the
    table instead of re-deriving it in each branch of its plan.
    """
    raw = cut_lineage(fx_raw_outcomes(spark, sf_dir))  # one lineitem pass; the grid reads raw three times
    # solution_id = (suppkey + linenumber) % 16: at most 16 solutions per problem by construction
    return cut_lineage(complete_grid(raw, hot=False))


def fx_outcome_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_outcomes plus error_message, timeouts and time limits (for the test-level report)."""
    g = fx_outcomes(spark, sf_dir)
    failed = F.col("reason") == "fail"
    return g.select(
        "problem_id",
        "solution_id",
        "test_id",
        "pass",
        F.when(failed & (((F.col("solution_id") + F.col("test_id")) % 7) == 0), F.lit("timeout"))
        .otherwise(F.col("reason"))
        .alias("reason"),
        F.when(
            failed,
            F.concat(
                F.lit("assertion "),
                (F.col("test_id") % 4).cast("string"),
                F.when((F.col("test_id") % 4) == 3, F.repeat(F.lit("x"), 120)).otherwise(F.lit("")),
            ),
        ).alias("error_message"),
        (F.lit(1.0) + (F.col("test_id") % 3)).cast("double").alias("time_limit"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins.  Every oracle query starts with ``WITH`` + one of these bodies.
# ---------------------------------------------------------------------------

FX_OUTCOMES_CTES = """
fx_c AS (
  SELECT CAST(floor(l_partkey/40) AS BIGINT) AS problem_id,
         CAST((l_suppkey + l_linenumber) % 16 AS BIGINT) AS solution_id,
         CAST(l_orderkey % 20 AS BIGINT) AS test_id, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2, 3),
fx_raw AS (
  SELECT problem_id, solution_id, test_id, q >= CASE
    WHEN problem_id % 5 = 3 OR test_id % 8 = 0 OR (problem_id % 5 = 4 AND test_id > 3) THEN 400
    WHEN problem_id % 5 = 0 OR test_id % 8 IN (1, 2) THEN 0
    ELSE 12 * (test_id % 8) + 6 * (solution_id % 6) END AS pass
  FROM fx_c),
fx_so AS (SELECT DISTINCT problem_id, solution_id FROM fx_raw),
fx_te AS (SELECT DISTINCT problem_id, test_id FROM fx_raw),
fx_outcomes AS (
  SELECT so.problem_id, so.solution_id, te.test_id, coalesce(o.pass, false) AS pass,
         CASE WHEN o.pass IS NULL THEN 'unexecuted' WHEN o.pass THEN 'pass' ELSE 'fail' END AS reason
  FROM fx_so so JOIN fx_te te ON so.problem_id = te.problem_id
  LEFT JOIN fx_raw o ON o.problem_id = so.problem_id AND o.solution_id = so.solution_id AND o.test_id = te.test_id),
fx_details AS (
  SELECT problem_id, solution_id, test_id, pass,
         CASE WHEN reason = 'fail' AND (solution_id + test_id) % 7 = 0 THEN 'timeout' ELSE reason END AS reason,
         CASE WHEN reason = 'fail' THEN concat('assertion ', CAST(test_id % 4 AS VARCHAR),
              CASE WHEN test_id % 4 = 3 THEN repeat('x', 120) ELSE '' END) END AS error_message,
         CAST(1.0 + test_id % 3 AS DOUBLE) AS time_limit
  FROM fx_outcomes)
"""


def with_fx(body: str, *extra_ctes: str) -> str:
    """Compose an oracle query: the fixture CTEs, any extra CTEs, then the body."""
    ctes = [FX_OUTCOMES_CTES.strip()] + [c.strip() for c in extra_ctes if c.strip()]
    return round6_sql("WITH " + ",\n".join(ctes) + "\n" + body.strip())


# ---------------------------------------------------------------------------
# Text fixtures (FIXTURES.md 3.2-3.6)
# ---------------------------------------------------------------------------

TEST_SEP = " ;; "  # separator used to show a list of tests as one comparable string


def _fx_tests(doc_id, n_chars, lang, source):
    return [
        F.concat(F.lit("assert f("), doc_id.cast("string"), F.lit(") == "), n_chars.cast("string")),
        F.concat(F.lit('assert g("'), lang, F.lit('", "a\\nb") == "'), source, F.lit('"')),
        F.concat(F.lit("assert h("), n_chars.cast("string"), F.lit(") is True")),
    ]


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a driver table (one file, one row group) to all cores before row-wise text work.

    For the fixtures only: stored tables of any size come in many splits, and
    the text functions themselves do not shuffle.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, response, text, lang, source, n_chars): model-like responses built from documents."""
    d = spread(read_table(spark, sf_dir, "documents"))
    tests = F.array(*_fx_tests(F.col("doc_id"), F.col("n_chars"), F.col("lang"), F.col("source")))
    base = F.to_json(F.struct(F.col("text").alias("question"), tests.alias("tests")))
    k = F.col("doc_id") % 6
    response = (
        F.when(k == 0, base)
        .when(k == 1, F.concat(F.lit("Here you go:\n```json\n"), base, F.lit("\n```\nHope it helps.")))
        .when(k == 2, F.concat(F.lit("```python\n"), base, F.lit("\n```")))
        .when(k == 3, F.concat(F.lit("```json\n"), F.expr("substring(base_json, 1, length(base_json) - 6)")))
        .when(k == 4, F.lit("ERROR: Timeout after 3 attempts"))
    )
    return d.withColumn("base_json", base).select(
        "doc_id", response.alias("response"), "text", "lang", "source", "n_chars"
    )


def fx_turns(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    """(problem_id, solution_id, turn, text, raw_text): all turns (or those of one role) wrapped four ways."""
    c = read_table(spark, sf_dir, "conversations")
    c = c.where(F.col("role") == role) if role else c
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    v = (F.col("conv_id") + F.col("turn")) % 4
    t = F.col("turn").cast("string")
    raw = (
        F.when(v == 0, F.col("text"))
        .when(v == 1, F.concat(F.lit("Let me think about turn "), t, F.lit(".</think>"), F.col("text")))
        .when(v == 2, F.concat(F.lit("Here:\n```python\n"), F.col("text"), F.lit("\n```\nDone.")))
        .otherwise(
            F.concat(
                F.lit("```python\nx = "), t, F.lit("\nprint(x)\n```\nand then\n```python\n"), F.col("text"),
                F.lit("\n    printer = 1\n```"),
            )
        )
    )
    return c.select(
        F.col("conv_id").alias("problem_id"),
        (F.row_number().over(w) - 1).cast("long").alias("solution_id"),
        "turn",
        "text",
        raw.alias("raw_text"),
    )


def fx_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, key, question, starter_code, solution) from benchmark and documents."""
    b = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("key"), "text"
    )
    d = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs_"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("key"), "text"
    )
    u = b.unionByName(d)
    m = F.col("key") % 3
    k = F.col("key").cast("string")
    return u.select(
        "id",
        F.split_part(F.col("id"), F.lit("_"), F.lit(1)).alias("source"),
        "key",
        F.col("text").alias("question"),
        F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("")).otherwise(F.lit("def f(x):")).alias(
            "starter_code"
        ),
        F.when(m == 0, F.lit(None).cast("string"))
        .when(m == 1, F.concat(F.lit("return "), k))
        .otherwise(F.concat(F.lit("```python\nreturn "), k, F.lit("\n```")))
        .alias("solution"),
    )


FX_TEXT_CTES = r"""
fx_docs AS (SELECT * FROM documents),
fx_tests AS (
  SELECT doc_id,
         'assert f(' || CAST(doc_id AS VARCHAR) || ') == ' || CAST(n_chars AS VARCHAR) AS t1,
         'assert g("' || lang || '", "a\nb") == "' || source || '"' AS t2,
         'assert h(' || CAST(n_chars AS VARCHAR) || ') is True' AS t3
  FROM documents),
fx_all_turns AS (
  SELECT conv_id AS problem_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS solution_id,
         turn, text, (conv_id + turn) % 4 AS v
  FROM conversations),
fx_turns AS (
  SELECT conv_id AS problem_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS solution_id,
         turn, text, (conv_id + turn) % 4 AS v
  FROM conversations WHERE role = 'assistant'),
fx_problems AS (
  SELECT id, split_part(id, '_', 1) AS source, key, text AS question,
         CASE key % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'def f(x):' END AS starter_code,
         CASE key % 3 WHEN 0 THEN NULL WHEN 1 THEN 'return ' || CAST(key AS VARCHAR)
              ELSE 'return ' || CAST(key AS VARCHAR) END AS unwrapped,
         CASE key % 3 WHEN 0 THEN NULL WHEN 1 THEN 'return ' || CAST(key AS VARCHAR)
              ELSE '```python' || chr(10) || 'return ' || CAST(key AS VARCHAR) || chr(10) || '```' END AS solution
  FROM (SELECT 'bench_' || CAST(item_id AS VARCHAR) AS id, item_id AS key, text FROM benchmark
        UNION ALL SELECT 'docs_' || CAST(doc_id AS VARCHAR) AS id, doc_id AS key, text FROM documents))
"""


def with_text(body: str, *extra_ctes: str) -> str:
    """Oracle query over the text fixtures."""
    ctes = [FX_TEXT_CTES.strip()] + [c.strip() for c in extra_ctes if c.strip()]
    return round6_sql("WITH " + ",\n".join(ctes) + "\n" + body.strip())
