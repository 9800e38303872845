"""H2: salvage a ``{"question": str, "tests": [str, ...]}`` object from messy model text.

Rules (kept from the reference):
1. strip; if ```json occurs keep the text after its first occurrence, else the
   same for ```python;
2. cut at the last ``` of what is left (even without an opening fence);
3. parse; when that fails keep the longest prefix whose completion with
   ``]}`` parses -- for this object shape that is every *complete* test string
   literal, and the question if it was complete;
4. nothing parses -> question null, tests null.

Caller rules (B5/B6): a null text, a non-object, or a missing key gives the
error question / sentinel tests; a non-string question is JSON-encoded, so a
null question becomes ``"null"``.

Step 3 for any shape: a prefix completed with ``]}`` parses exactly if it is
a valid beginning of JSON whose open brackets are ``{[`` and that stands after
``[`` or after a complete element.  A small push-down scan finds the longest
one: the text is cut into JSON tokens once, and a fold over them carries the
open brackets, what may come next, and where the last ``question`` and
``tests`` members of the object lie (the last of repeated keys wins).

Spark plan: ``try_parse_json`` (variant) for step 3; the scan runs only where
that fails (cut or broken text, repeated keys).  Token patterns are possessive:
a backtracking literal pattern overflows the JVM stack on very long literals.
Prose around unfenced JSON leaves nothing to salvage.  ``NaN`` and the
infinities, which are not JSON, end the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FENCE, after_first, py_strip

# fixed values
ERROR_QUESTION = "Error in question generation"
ERROR_TESTS = ["assert False"]

# a valid JSON string literal: no raw control characters, only the escapes JSON knows
LIT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
# one token of JSON text, a run of white space, or one character that fits nowhere
TOKEN = r"(?s)" + LIT + "|" + NUMBER + r"|true|false|null|[\[\]{},:]|[ \t\n\r]++|."


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _next(s: Column, token: Column) -> Column:
    """What may come after ``token``: the rules of JSON."""
    inner, at_end = F.right(s["open"], F.lit(1)), s["next"] == "end"
    wants_value = s["next"].isin("value", "first")
    text = token.startswith('"') & (F.length(token) > 1)
    value = text | token.rlike("^-?[0-9]") | token.isin("true", "false", "null")
    return (
        F.when(value & wants_value, "end")
        .when(text & s["next"].isin("key", "name"), "colon")
        .when((token == ":") & (s["next"] == "colon"), "value")
        .when((token == "[") & wants_value, "first")
        .when((token == "{") & wants_value, "key")
        .when((token == ",") & at_end & (inner == "["), "value")
        .when((token == ",") & at_end & (inner == "{"), "name")
        .when((token == "]") & (inner == "[") & (at_end | (s["next"] == "first")), "end")
        .when((token == "}") & (inner == "{") & (at_end | (s["next"] == "key")), "end")
        .otherwise("dead")
    )


def _scan(tokens: Column) -> Column:
    """Fold over the tokens of a text.

    State: ``open`` brackets; ``next``: value, first (value or ``]``), key (or
    ``}``), name (a key), colon, end (comma or a closing bracket) or dead;
    ``at``: characters read; ``key``: the running member of the object;
    ``start``: where its value begins; ``q`` and ``t``: places of the last
    complete question and tests; ``best``: the state at the last place where
    ``]}`` would complete the text.
    """
    span = "struct<start:int,size:int>"
    none = F.lit(None).cast(span)
    found = F.struct(F.lit(-1).alias("at"), F.lit("").alias("key"), F.lit(0).alias("start"), none.alias("q"), none.alias("t"))
    zero = F.struct(F.lit("").alias("open"), F.lit("value").alias("next"), F.lit(0).alias("at"), F.lit("").alias("key"), F.lit(0).alias("start"), none.alias("q"), none.alias("t"), found.alias("best"))

    def after(s: Column, token: Column, now: Column) -> Column:
        opened = (
            F.when(token.isin("[", "{") & (now != "dead"), F.concat(s["open"], token))
            .when(token.isin("]", "}") & (now != "dead"), F.left(s["open"], F.length(s["open"]) - 1))
            .otherwise(s["open"])
        )
        end = s["at"] + F.length(token)
        key = F.when((now == "colon") & (s["open"] == "{"), token).otherwise(s["key"])
        start = F.when((s["open"] == "{") & (s["next"] == "value"), s["at"]).otherwise(s["start"])
        return F.struct(opened.alias("open"), now.alias("next"), end.alias("at"), key.alias("key"), start.alias("start"))

    def places(s: Column, n: Column) -> Column:
        whole = (n["next"] == "end") & (n["open"] == "{")  # a member of the object is complete
        place = F.struct(n["start"].alias("start"), (n["at"] - n["start"]).alias("size"))
        return F.struct(
            F.when(whole & (n["key"] == '"question"'), place).otherwise(s["q"]).alias("q"),
            F.when(whole & (n["key"] == '"tests"'), place).otherwise(s["t"]).alias("t"),
        )

    def moved(s: Column, n: Column, p: Column) -> Column:
        here = F.struct(n["at"].alias("at"), n["key"].alias("key"), n["start"].alias("start"), p["q"].alias("q"), p["t"].alias("t"))
        best = F.when((n["open"] == "{[") & n["next"].isin("end", "first"), here).otherwise(s["best"])
        return F.struct(n["open"], n["next"], n["at"], n["key"], n["start"], p["q"], p["t"], best.alias("best"))

    def step(s: Column, token: Column) -> Column:
        blank = F.struct(s["open"], s["next"], (s["at"] + F.length(token)).alias("at"), s["key"], s["start"], s["q"], s["t"], s["best"])
        read = _let(_next(s, token), lambda now: _let(after(s, token, now), lambda n: _let(places(s, n), lambda p: moved(s, n, p))))
        return F.when(s["next"] == "dead", s).when(token.rlike(r"^[ \t\n\r]"), blank).otherwise(read)

    return F.aggregate(tokens, zero, step)


def json_region(s: Column) -> Column:
    """Steps 1-2: fence selection and the cut at the last fence."""
    t = py_strip(s)
    t = F.coalesce(after_first(t, "```json"), after_first(t, "```python"), t)
    last = F.length(t) - F.locate(FENCE, F.reverse(t)) - len(FENCE) + 1  # a fence reads the same from behind
    return F.when(F.locate(FENCE, t) > 0, t.substr(F.lit(1), last)).otherwise(t)


def two_elements(text: Column) -> Column:
    """The text as the first of two elements: the parser stops after a first value, so on its own it would accept any text after it."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]')))


def first_if_whole(two: Column) -> Column:
    """The variant of a text from its ``two_elements``, null unless the text is one whole JSON value."""
    is_whole = (F.try_variant_get(two, "$[1]", "string") == "end") & F.try_variant_get(two, "$[2]", "variant").isNull()
    return F.when(is_whole, F.try_variant_get(two, "$[0]", "variant"))


def parse_responses(df: DataFrame, text: str, problem: str = "problem", tests: str = "tests") -> DataFrame:
    """Add ``problem`` and ``tests`` parsed from column ``text`` (rules above + caller rules).

    - null text or a parsed non-object -> error question + sentinel tests;
    - nothing salvageable -> question ``"null"``, tests null;
    - a missing key -> error question / sentinel tests for that key.

    Each stage is its own projection: the region, the variant and the
    fallback are computed once per row and reused by every rule below.
    """
    s = F.col(text)
    d = df.withColumn("_region", json_region(s))
    d = d.withColumn("_two", two_elements(F.col("_region")))
    d = d.withColumn("_v", first_if_whole(F.col("_two")))
    v = F.col("_v")
    d = d.withColumn(
        "_p",
        F.when(
            v.isNotNull(),
            F.struct(
                F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"),
                F.try_variant_get(v, "$.question", "variant").alias("qv"),
                F.try_variant_get(v, "$.tests", "variant").alias("tv"),
            ),
        ),
    )
    # the scan only for rows that did not parse
    broken = v.isNull() & s.isNotNull()
    d = d.withColumn("_s", F.when(broken, _scan(F.regexp_extract_all("_region", F.lit(TOKEN), F.lit(0)))))
    complete = (F.col("_s.next") == "end") & (F.col("_s.open") == "")  # valid, with repeated keys
    b = F.col("_s.best")
    cut = lambda place: F.substring(F.col("_region"), place["start"] + 1, place["size"])
    running = F.concat(F.substring(F.col("_region"), b["start"] + 1, b["at"] - b["start"]), F.lit("]"))
    q_text = F.when(complete, cut(F.col("_s.q"))).otherwise(F.when(b["key"] == '"question"', running).otherwise(cut(b["q"])))
    t_text = F.when(complete, cut(F.col("_s.t"))).otherwise(F.when(b["key"] == '"tests"', running).otherwise(cut(b["t"])))
    d = d.withColumn(
        "_f", F.when(broken, F.struct((complete | (b["at"] >= 0)).alias("found"), F.try_parse_json(q_text).alias("qv"), F.try_parse_json(t_text).alias("tv")))
    )
    sentinel = F.array(*[F.lit(t) for t in ERROR_TESTS])
    bad = s.isNull() | (v.isNotNull() & ~F.col("_p.is_object"))
    lost = v.isNull() & ~F.col("_f.found")
    qv, tv = F.coalesce(F.col("_p.qv"), F.col("_f.qv")), F.coalesce(F.col("_p.tv"), F.col("_f.tv"))
    q_str = F.when(F.schema_of_variant(qv) == "STRING", F.try_variant_get(qv, "$", "string")).otherwise(F.to_json(qv))
    out_problem = F.when(bad, ERROR_QUESTION).when(lost, "null").when(qv.isNull(), ERROR_QUESTION).otherwise(F.coalesce(q_str, F.lit("null")))
    out_tests = F.when(bad, sentinel).when(lost, F.lit(None).cast("array<string>")).when(tv.isNull(), sentinel).otherwise(F.try_variant_get(tv, "$", "array<string>"))
    # The result comes out of a one-row generator: a later filter on it cannot be
    # pushed below the generator, so the parse runs once.
    keep = [c for c in d.columns if c not in ("_region", "_two", "_v", "_p", "_s", "_f")]
    return d.select(*keep, F.inline(F.array(F.struct(out_problem.alias(problem), out_tests.alias(tests)))))


def fill_sentinel(tests: Column | str) -> Column:
    """The sentinel tests where there are none (null or an empty list)."""
    t = F.col(tests) if isinstance(tests, str) else tests
    return F.when(t.isNull() | (F.size(t) == 0), F.array(*[F.lit(x) for x in ERROR_TESTS])).otherwise(t)


def is_valid_response(response: Column, tests: Column) -> Column:
    """Response non-empty and not the error text; tests non-empty and not the sentinel."""
    sentinel = F.array(*[F.lit(t) for t in ERROR_TESTS])
    return (
        response.isNotNull()
        & (response != "")
        & (response != ERROR_QUESTION)
        & tests.isNotNull()
        & (F.size(tests) > 0)
        & ~F.coalesce(tests == sentinel, F.lit(False))
    )


__all__ = ["ERROR_QUESTION", "ERROR_TESTS", "parse_responses", "fill_sentinel", "is_valid_response"]
