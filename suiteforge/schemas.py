"""Fixed schemas of the normalised tables and the nested form.

``to_nested`` / ``from_nested`` convert between the long outcome table and
the one-row-per-problem JSON form with per-solution status lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

PROBLEMS = StructType(
    [
        StructField("problem_id", StringType()),
        StructField("source", StringType()),
        StructField("question", StringType()),
        StructField("starter_code", StringType()),
        StructField("solution", StringType()),
        StructField("problem", StringType()),
        StructField("program", StringType()),
    ]
)

RESPONSES = StructType(
    [
        StructField("hash_id", StringType()),
        StructField("prompt", StringType()),
        StructField("response", StringType()),
        StructField("seq", LongType()),
        StructField("error_class", StringType()),
    ]
)

SOLUTIONS = StructType(
    [
        StructField("problem_id", LongType()),
        StructField("solution_id", LongType()),
        StructField("raw_text", StringType()),
        StructField("code", StringType()),
    ]
)

TESTS = StructType(
    [
        StructField("problem_id", LongType()),
        StructField("test_id", LongType()),
        StructField("test_text", StringType()),
        StructField("origin", StringType()),
        StructField("round", IntegerType()),
    ]
)

OUTCOMES = StructType(
    [
        StructField("problem_id", LongType()),
        StructField("solution_id", LongType()),
        StructField("test_id", LongType()),
        StructField("pass", BooleanType()),
        StructField("reason", StringType()),
        StructField("error_message", StringType()),
        StructField("time_limit", DoubleType()),
    ]
)

SELECTIONS = StructType(
    [
        StructField("problem_id", LongType()),
        StructField("round", IntegerType()),
        StructField("kind", StringType()),
        StructField("slot", LongType()),
        StructField("solution_id", LongType()),
        StructField("status", StringType()),
    ]
)

METRICS = StructType(
    [
        StructField("metric", StringType()),
        StructField("key", StringType()),
        StructField("value", DoubleType()),
        StructField("n", LongType()),
    ]
)


DETAILS = ("pass", "reason", "error_message", "time_limit")


def to_nested(outcomes: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """Long outcomes -> one row per problem with per-solution ``eval_results``
    (``pass_rate`` and ``test_cases_pass_status``, ordered by test id).

    Test ids and all detail columns that ``outcomes`` has are kept.  Problems
    of ``problems`` without outcomes get an empty list.  This is an export
    format: each problem row holds its own matrix.
    """
    details = [c for c in DETAILS if c in outcomes.columns]
    per_solution = outcomes.where("solution_id is not null").groupBy("problem_id", "solution_id").agg(
        F.avg(F.col("pass").cast("int")).alias("pass_rate"),
        F.sort_array(F.collect_list(F.struct("test_id", *details))).alias("test_cases_pass_status"),
    )
    nested = per_solution.groupBy("problem_id").agg(
        F.sort_array(F.collect_list(F.struct("solution_id", "pass_rate", "test_cases_pass_status"))).alias("eval_results")
    )
    every = outcomes.select("problem_id") if problems is None else problems.select("problem_id").union(outcomes.select("problem_id"))
    empty = F.array().cast(nested.schema["eval_results"].dataType)
    return every.distinct().join(nested, "problem_id", "left").withColumn("eval_results", F.coalesce("eval_results", empty))


def from_nested(nested: DataFrame) -> DataFrame:
    """Nested form -> long outcomes; ids that the form does not carry are positions.

    A problem without results is one row with null solution and test, so that
    :func:`to_nested` gives it back.
    """
    status = nested.schema["eval_results"].dataType.elementType["test_cases_pass_status"].dataType.elementType
    sol = nested.select("problem_id", F.posexplode_outer("eval_results").alias("_si", "r"))
    tests = sol.select(
        "problem_id",
        F.coalesce(F.col("r.solution_id"), F.col("_si").cast("long")).alias("solution_id"),
        F.posexplode_outer("r.test_cases_pass_status").alias("_ti", "s"),
    )
    own = F.coalesce(F.col("s.test_id"), F.col("_ti").cast("long")) if "test_id" in status.names else F.col("_ti").cast("long")
    return tests.select("problem_id", "solution_id", own.cast("long").alias("test_id"), *[F.col(f"s.{c}").alias(c) for c in DETAILS if c in status.names])
