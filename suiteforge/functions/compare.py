"""Tolerant output comparison (H20-H23, H25-H28) as column expressions.

The stdin-style ladder (H21) stops at the first rung that matches and names
it: ``exact`` (whole text after strip), ``line_strip`` (lines stripped, or the
expected text's non-blank stripped lines), ``blank_drop`` (blank output lines
dropped), ``numeric`` (same length, not all integer-like, every pair within
``1e-8 + 1e-5 * |expected|``), else ``none``.  The reference's later
token-set rung never compares anything, so it is not a rung here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .salvage import TOKEN, first_if_whole, two_elements
from .text import py_strip, split_lines

# fixed values: tolerance of the numeric rung (numpy.allclose defaults)
ATOL, RTOL = 1e-8, 1e-5


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_like(s: Column | str) -> Column:
    """Digits only (no sign), as ``str.isdigit``."""
    return F.coalesce(_c(s).rlike("^[0-9]+$"), F.lit(False))


# fixed values: what counts as a number in program output (no type suffixes), and an infinity
FINITE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def _number(s: Column) -> Column:
    """The number a stripped line stands for, null for anything else (``nan`` too: it is close to nothing)."""
    s = py_strip(s)
    return F.when(s.rlike(FINITE), s.try_cast("double")).when(s.rlike(INFINITE), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def _close(a: Column, b: Column) -> Column:
    """``abs(a - b) <= ATOL + RTOL * abs(b)``; an infinity is close to the same infinity only."""
    infinite = F.abs(a).isin(float("inf")) | F.abs(b).isin(float("inf"))
    return F.when(infinite, a == b).otherwise(F.abs(a - b) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(b))


def _by_value(token: Column) -> Column:
    """One JSON token as the value it stands for: numbers in one spelling, true and false as 1 and 0."""
    x = token.try_cast("double")
    whole = (F.abs(x) < 1e18) & (x == F.floor(x))
    number = F.when(token.rlike("^-?[0-9]+$"), F.when(token == "-0", "0").otherwise(token)).when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    return F.when(token == "true", "1").when(token == "false", "0").when(token.rlike("^-?[0-9]"), number).otherwise(token)


def canonical_value(v: Column) -> Column:
    """Text that is equal for equal values: compact, keys in order, numbers and booleans by value (``1e2`` is 100, ``true`` is 1) at every depth."""
    return F.array_join(F.transform(F.regexp_extract_all(F.to_json(v), F.lit(TOKEN), F.lit(0)), _by_value), "")


def parse_whole(s: Column | str) -> Column:
    """Variant of a text that is one JSON value (null for anything else, trailing text included)."""
    return first_if_whole(two_elements(_c(s)))


def canonical_json(s: Column | str) -> Column:
    """``canonical_value`` of a JSON text (null when the text is not JSON)."""
    return canonical_value(parse_whole(s))


def call_result_match(actual_json: Column | str, expected_json: Column | str) -> Column:
    """Call-style result equals expected, or equals the first element of a
    non-empty expected list; values are equal as in the language of the tests
    (numbers and booleans by value, at every depth, keys in any order)."""
    a, ev = canonical_json(actual_json), parse_whole(expected_json)
    first = canonical_value(F.try_variant_get(ev, "$[0]", "variant"))
    is_list = F.coalesce(F.schema_of_variant(ev).startswith("ARRAY"), F.lit(False))
    return F.coalesce(a == canonical_value(ev), F.lit(False)) | (is_list & F.coalesce(a == first, F.lit(False)))


def int_keys(m: Column | str) -> Column:
    """Map with integer keys restored from JSON string keys."""
    return F.transform_keys(_c(m), lambda k, v: k.cast("int"))


def is_floats(v: Column | str) -> Column:
    """A JSON value that is a float, or a non-empty list of floats."""
    var = F.try_parse_json(_c(v))
    sch = F.schema_of_variant(var)
    scalar = sch.startswith("DOUBLE") | sch.startswith("DECIMAL") | sch.startswith("FLOAT")
    arr = sch.startswith("ARRAY<DOUBLE") | sch.startswith("ARRAY<DECIMAL") | sch.startswith("ARRAY<FLOAT")
    nonempty = F.coalesce(F.size(F.try_variant_get(var, "$", "array<string>")) > 0, F.lit(False))
    return F.coalesce(scalar | (arr & nonempty), F.lit(False))


def file_count(files: Column | str) -> Column:
    """The ``files`` list reduced to its count (``nfiles``)."""
    return F.size(_c(files)).cast("long")


def test_kind(tests_json: Column | str) -> Column:
    """``assert`` when the tests text is a JSON list, ``io`` when an object."""
    first = F.substring(F.ltrim(_c(tests_json)), 1, 1)
    return F.when(first == "[", F.lit("assert")).when(first == "{", F.lit("io"))


def compare_outputs(df: DataFrame, actual: str, expected: str, out: str = "rung") -> DataFrame:
    """H21 on a DataFrame, staged: the line arrays are computed once per row in
    their own projection and every rung reads them.

    ``expected`` is the expected text, or an array of expected lines.
    """
    listed = dict(df.dtypes)[expected].startswith("array")
    e_text = F.array_join(expected, "\n") if listed else F.col(expected)
    e_lines = F.col(expected) if listed else F.split(F.col(expected), "\n", -1)
    d = df.withColumn("_out", split_lines(actual)).withColumn(
        "_el", F.transform(F.filter(e_lines, lambda x: F.length(x) > 0), py_strip)
    )
    d = d.withColumn("_nb", F.filter("_out", lambda x: F.length(x) > 0)).withColumn("_es", py_strip(e_text))
    pairs = F.arrays_zip(F.col("_nb").alias("o"), F.col("_el").alias("g"))
    d = d.withColumn("_pairs", F.when(F.size("_nb") == F.size("_el"), pairs))
    num = F.transform("_pairs", lambda p: F.struct(
        (int_like(p["o"]) & int_like(p["g"])).alias("ints"),
        _number(p["o"]).alias("a"),
        _number(p["g"]).alias("b"),
    ))
    d = d.withColumn("_num", num)
    all_ints = F.forall("_num", lambda x: x["ints"])
    all_num = F.forall("_num", lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    close = F.forall("_num", lambda x: _close(x["a"], x["b"]))
    rung = (
        F.when(py_strip(F.array_join("_out", "\n")) == F.col("_es"), F.lit("exact"))
        .when(py_strip(F.array_join(F.transform("_out", py_strip), "\n")) == F.col("_es"), F.lit("line_strip"))
        .when(F.col("_out") == (F.col(expected) if listed else F.array(F.col(expected))), F.lit("exact"))
        .when(F.col("_out") == F.col("_el"), F.lit("line_strip"))
        .when(F.col("_nb") == F.col("_el"), F.lit("blank_drop"))
        .when(F.col("_num").isNotNull() & ~all_ints & all_num & close, F.lit("numeric"))
        .otherwise(F.lit("none"))
    )
    return d.withColumn(out, rung).drop("_out", "_el", "_nb", "_es", "_pairs", "_num")
