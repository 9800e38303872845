"""Hand cases for the exact rules of SURVEY 2.9.1 / 2.9.2 and the text functions."""

import pytest
from pyspark.sql import functions as F

from suiteforge.functions import compare as cmp
from suiteforge.functions import salvage as sv
from suiteforge.functions import text as tx
from suiteforge.operators import outcomes as oc
from suiteforge.operators import select as sel
from suiteforge.operators import stats as st
from suiteforge.operators import suites as su

SENT = ["assert False"]
EQ = sv.ERROR_QUESTION

SALVAGE_CASES = [
    ('{"question": "q", "tests": ["a", "b"]}', "q", ["a", "b"]),
    ('```json\n{"question": "q", "tests": ["a"]}\n```', "q", ["a"]),
    ('prose ```python\n{"question": "q", "tests": ["a"]}```', "q", ["a"]),
    ('{"question": "q", "tests": ["a", "b", "c', "q", ["a", "b"]),
    ('{"question": "q", "tests": ["a\\"x", "b', "q", ['a"x']),
    ("ERROR: Timeout after 3 attempts", "null", None),
    (None, EQ, SENT),
    ("[1, 2]", EQ, SENT),
    ('{"tests": ["a"]}', EQ, ["a"]),
    ('{"question": null, "tests": ["a"]}', "null", ["a"]),
    ('{"question": "q"}', "q", SENT),
    ('xx ``` {"question": "q", "tests": ["a"]}', "null", None),
    ('{"question": "q", "tests": []}', "q", []),
    ('  {"question": "q\\nr", "tests": ["x"]}  ', "q\nr", ["x"]),
]


def test_salvage_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SALVAGE_CASES)], "i int, r string")
    got = {r.i: (r.problem, r.tests) for r in sv.parse_responses(df, "r").collect()}
    for i, (_, q, t) in enumerate(SALVAGE_CASES):
        assert got[i] == (q, t), SALVAGE_CASES[i]


def test_valid_response_filter(spark):
    rows = [("ok", ["a"]), ("", ["a"]), (EQ, ["a"]), ("ok", SENT), ("ok", []), ("ok", None)]
    df = spark.createDataFrame(rows, "r string, t array<string>")
    got = [r.v for r in df.select(sv.is_valid_response(F.col("r"), F.col("t")).alias("v")).collect()]
    assert got == [True, False, False, False, False, False]


LADDER = [
    ("1 2\n", "1 2", "exact"),
    ("a \nb ", "a\nb", "line_strip"),
    ("1\n\n2", "1\n2", "blank_drop"),
    ("1.0000001\n2.5", "1.0\n2.5", "numeric"),
    ("3\n4", "3\n5", "none"),
    ("2 1", "1 2", "none"),
    ("1.1\n2", "1.0\n2", "none"),
    ("5.0", "inf", "none"),
    ("5.0", "nan", "none"),
    ("nan", "nan ", "exact"),
    ("nan\n1.0", "nan\n1", "none"),
    ("2", "-inf", "none"),
    ("inf\n2.0", "Infinity\n2", "numeric"),
    ("3.5", "3.5f", "none"),
    ("3.5", "3.5d", "none"),
    ("1e2", "100.0", "numeric"),
    (".5", "0.5", "numeric"),
]


def test_salvage_of_broken_objects(spark):
    """The rule keeps the longest prefix that completes to valid JSON; anything broken before the tests leaves nothing."""
    q, t = sv.ERROR_QUESTION, sv.ERROR_TESTS
    long = "x" * 300_000
    cases = [
        ('{"question": "q", "tests": ["assert a", "assert\nb"]}', "q", ["assert a"]),  # raw line end in a literal
        ('{"question": "q", "tests": ["assert a", "\\d+"]}', "q", ["assert a"]),  # an escape that JSON has not
        ('{"question": "q\nr", "tests": ["assert a"]}', "null", None),
        ('Sure: {"question": "q", "tests": ["assert a"]} done', "null", None),
        ('{"id": 3, "question": "q", "tests": ["assert a", "ass', "q", ["assert a"]),
        ('{"question": "q", "tests": ["assert a", "assert \\u0041", "b', "q", ["assert a", "assert A"]),
        ('{"question": "q", "tests": ["' + long + '", "b', "q", [long]),
        ('{"tests": ["assert a", "b', q, ["assert a"]),
        (None, q, t),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    got = {r.i: (r.problem, r.tests) for r in sv.parse_responses(df, "r").collect()}
    for i, (text, problem, tests) in enumerate(cases):
        assert got[i] == (problem, tests), (text or "")[:80]


def test_sentinel_fills_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["a"])], "i int, tests array<string>")
    got = {r.i: r.t for r in df.select("i", sv.fill_sentinel("tests").alias("t")).collect()}
    assert got == {1: sv.ERROR_TESTS, 2: sv.ERROR_TESTS, 3: ["a"]}


def test_compare_ladder(spark):
    df = spark.createDataFrame([(a, e) for a, e, _ in LADDER], "a string, e string")
    got = [r.rung for r in cmp.compare_outputs(df, "a", "e").collect()]
    assert sorted(got) == sorted(x for _, _, x in LADDER)
    want = {(a, e): x for a, e, x in LADDER}
    assert all(want[r.a, r.e] == r.rung for r in cmp.compare_outputs(df, "a", "e").collect())


def test_compare_lists_of_lines(spark):
    rows = [("1\n2\n", ["1", "2"], "exact"), ("1 \n2", ["1", "2"], "line_strip"), ("1\n\n2", ["1", "2"], "blank_drop"), ("1.0\n2", ["1", "2"], "numeric"), ("2\n1", ["1", "2"], "none")]
    df = spark.createDataFrame([(a, e) for a, e, _ in rows], "a string, e array<string>")
    want = {(a, tuple(e)): x for a, e, x in rows}
    assert all(want[r.a, tuple(r.e)] == r.rung for r in cmp.compare_outputs(df, "a", "e").collect())


def test_call_result_match(spark):
    rows = [("[1, 2]", "[1,2]", True), ("3", "[3, 4]", True), ("3", "[]", False), ('{"a": 1}', '{ "a" : 1 }', True), ("1", "2", False),
            ('{"k": 69}', '{"k": 69.0}', True), ('{"k": 6.5}', '{"k": 6.50}', True)]
    df = spark.createDataFrame([(a, e) for a, e, _ in rows], "a string, e string")
    got = [r.m for r in df.select(cmp.call_result_match("a", "e").alias("m")).collect()]
    assert got == [x for _, _, x in rows]


def test_unwrap_fence(spark):
    cases = [("```python\n\nx\n```", "x"), ("```\nx```", "x"), ("x```", "x```"), ("```pythonx", "x"), ("```python\nx\n", "x\n"), (None, None)]
    df = spark.createDataFrame(cases, "s string, want string")
    for r in df.select(tx.unwrap_fence("s").alias("got"), "want").collect():
        assert r.got == r.want


def test_truncate_mid(spark):
    s = "a" * 150 + "b" * 152
    r = spark.createDataFrame([(s,)], "s string").select(
        tx.truncate_mid("s", 300).alias("t"), tx.truncate_mid("s", 301).alias("u"), tx.truncate_mid("s", 302).alias("v")
    ).first()
    assert r.t == "a" * 150 + "...(truncated) ..." + "b" * 150
    assert r.u == "a" * 150 + "...(truncated) ..." + "b" * 151
    assert r.v == s


PRETTY = [
    ("microsoft/DialoGPT-medium", "DialoGPT_medium"),
    ("/path/to/model/checkpoint.bin", "checkpoint"),
    ("https://example.com/model.tar.gz", "model.tar.gz"),
    ("", "unnamed"),
    ("   ", "unnamed"),
    ("123-abc", "model_123_abc"),
    ("a/.hidden", "hidden"),
    ("org/name v2!", "name_v2"),
]


def test_pretty_name_full(spark):
    df = spark.createDataFrame(PRETTY, "s string, want string")
    for r in df.select(tx.pretty_name_full("s").alias("got"), "want").collect():
        assert r.got == r.want


def test_assert_parts(spark):
    rows = [("assert f(1, 2) == 3", "f", "1, 2", "3"), ("assert is_ok(x) is True", "is_ok", "x", "True")]
    df = spark.createDataFrame(rows, "t string, e string, i string, o string")
    inp, out = tx.assert_parts(F.col("t"))
    for r in df.select(tx.assert_entry_point("t").alias("ge"), inp.alias("gi"), out.alias("go"), "e", "i", "o").collect():
        assert (r.ge, r.gi, r.go) == (r.e, r.i, r.o)


def test_think_and_blocks(spark):
    df = spark.createDataFrame([("a</think>b</think>c", "<python>x</python> ```python\ny```", "```python\n a \n```")], "a string, b string, c string")
    r = df.select(
        tx.think_strip("a").alias("t"), tx.parse_code("b", "all").alias("p"), tx.parse_code("c", "first").alias("f"),
        tx.first_code_block("c").alias("h1"), tx.last_code_block("a").alias("h10"),
    ).first()
    assert r.t == "b</think>c" and r.p == "x" and r.f == "a" and r.h1 == "\n a \n" and r.h10 == "a</think>b</think>c"


def test_strip_prints(spark):
    df = spark.createDataFrame([("x = 1\n  print(x)\nprinter = 2\ny = 3\n",)], "s string")
    assert df.select(tx.strip_prints("s").alias("o")).first().o == "x = 1\ny = 3"


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "problem_id long, solution_id long, test_id long, pass boolean")


def test_weak_threshold_edge(spark):
    rows = [(1, s, 0, s == 0) for s in range(10)] + [(1, s, 1, False) for s in range(10)]
    weak = {r.test_id for r in su.weak_tests(_outcomes(spark, rows)).collect()}
    assert weak == {1}  # exactly 0.1 stays


def test_top_two_ties(spark):
    rates = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.9)], "problem_id long, solution_id long, pass_rate double")
    assert sorted(r.solution_id for r in sel.top_two(rates).collect()) == [1, 2]


def test_unbiased_pass_at_k(spark):
    df = spark.createDataFrame([(5, 2, 1), (5, 0, 1), (5, 5, 2), (10, 3, 5)], "n long, c long, k long")
    got = [round(r.v, 6) for r in df.select(st.unbiased_pass_at_k_expr(F.col("n"), F.col("c"), F.col("k")).alias("v")).collect()]
    assert got == [0.4, 0.0, 1.0, round(1 - 21 / 252, 6)]


def test_histogram_edges(spark):
    vals = [0.0, 0.1, 0.3, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r.b for r in df.select(st.hist_bin(F.col("x")).alias("b")).collect()] == [0, 1, 3, 9, 9, 9]


def test_status_rollup(spark):
    o = _outcomes(spark, [(1, 0, 0, True), (1, 0, 1, False), (1, 1, 0, True), (1, 2, 0, True)])
    status = spark.createDataFrame([(1, 0, "pass"), (1, 1, "pass"), (1, 2, None)], "problem_id long, solution_id long, status string")
    got = {r.solution_id: r.final_status for r in oc.status_rollup(status, o).collect()}
    assert got == {0: "fail", 1: "pass", 2: "timeout"}


def test_complete_grid_unexecuted(spark):
    o = _outcomes(spark, [(1, 0, 0, True), (1, 1, 1, False)])
    g = {(r.solution_id, r.test_id): (r["pass"], r.reason) for r in oc.complete_grid(o).collect()}
    assert g == {(0, 0): (True, "pass"), (0, 1): (False, "unexecuted"), (1, 0): (False, "unexecuted"), (1, 1): (False, "fail")}


@pytest.mark.parametrize("mode", ["all", "first", "last", "all_in_last_turn"])
def test_parse_code_modes_no_blocks(spark, mode):
    df = spark.createDataFrame([("no code here",)], "s string")
    assert df.select(tx.parse_code("s", mode).alias("c")).first().c == ""


def test_request_params(spark):
    from suiteforge.functions.requests import request_params

    df = spark.createDataFrame([("o3-mini", 0.7, 0.9, 100, None), ("gpt-x", 0.7, 0.9, 100, 5)], "m string, t double, p double, n long, s long")
    got = [r.r for r in df.select(request_params(F.col("m"), F.col("t"), F.col("p"), F.col("n"), F.col("s")).alias("r")).collect()]
    assert (got[0].temperature, got[0].top_p, got[0].seed) == (None, None, None)
    assert (got[1].temperature, got[1].top_p, got[1].seed) == (0.7, 0.9, 5)


def test_message_keys(spark):
    import hashlib
    import json

    from suiteforge.functions.hashing import messages_key, messages_key_compat, text_key

    rows = [([("user", "Hello"), ("assistant", "Hi!")],), ([("user", "Grüße")],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string, content:string>>")
    got = df.select(messages_key("m").alias("a"), messages_key_compat("m").alias("b")).collect()
    want = []
    for (msgs,) in rows:
        s = json.dumps([{"role": r, "content": c} for r, c in msgs], sort_keys=True, separators=(",", ":"))
        want.append(hashlib.sha256(s.encode("utf-8")).hexdigest())
    assert got[0].a == want[0] and got[0].b == want[0]  # ASCII: both paths agree
    assert got[1].b == want[1]  # non-ASCII: the compat helper reproduces the escaping
    t = spark.createDataFrame([("abc",)], "s string").select(text_key("s").alias("h")).first().h
    assert t == hashlib.sha256(b"abc").hexdigest()


def test_line_guard_boundary(spark):
    body = "```python\nx = 1\n```"
    at_limit = body + "\n" * (500 - 3)  # 500 lines: extraction applies
    over = body + "\n" * (501 - 3)  # 501 lines: raw text is kept
    df = spark.createDataFrame([(at_limit,), (over,)], "s string")
    got = [r.g for r in df.select(tx.guarded_code("s").alias("g")).collect()]
    assert got == ["\nx = 1\n", over]
