"""Registered queries for the text layer (M5) and their DuckDB oracles.

The oracle side rebuilds the expected values either from the source columns
(by construction of the fixture) or with DuckDB's own string functions.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..fixtures import TEST_SEP, _fx_tests, fx_outcomes, fx_problems, fx_responses, fx_turns, with_fx, with_text
from ..functions import salvage as sv
from ..functions import text as tx
from ..functions.hashing import messages_key
from ..operators.outcomes import P, S, T
from ..session import read_table
from .registry import register

NL = "chr(10)"

RAW_TURN = f"""fx_raw_turns AS (
  SELECT problem_id, solution_id, turn, text, v,
         CASE v WHEN 0 THEN text
                WHEN 1 THEN 'Let me think about turn ' || CAST(turn AS VARCHAR) || '.</think>' || text
                WHEN 2 THEN 'Here:' || {NL} || '```python' || {NL} || text || {NL} || '```' || {NL} || 'Done.'
                ELSE '```python' || {NL} || 'x = ' || CAST(turn AS VARCHAR) || {NL} || 'print(x)' || {NL} || '```' || {NL}
                     || 'and then' || {NL} || '```python' || {NL} || text || {NL} || '    printer = 1' || {NL} || '```' END AS raw_text
  FROM fx_all_turns)"""


def _join_tests(arr):
    return F.when(arr.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(arr, TEST_SEP))


def _n(arr):
    return F.when(arr.isNull(), F.lit(None).cast("long")).otherwise(F.size(arr).cast("long"))


SALVAGE_EXPECTED = f"""fx_expected AS (
  SELECT d.doc_id, d.doc_id % 6 AS k,
         CASE d.doc_id % 6 WHEN 5 THEN 'Error in question generation' WHEN 4 THEN 'null' ELSE d.text END AS problem,
         CASE d.doc_id % 6 WHEN 5 THEN 'assert False' WHEN 4 THEN NULL
              WHEN 3 THEN t.t1 || '{TEST_SEP}' || t.t2
              ELSE t.t1 || '{TEST_SEP}' || t.t2 || '{TEST_SEP}' || t.t3 END AS tests_text,
         CAST(CASE d.doc_id % 6 WHEN 5 THEN 1 WHEN 4 THEN NULL WHEN 3 THEN 2 ELSE 3 END AS BIGINT) AS n_tests
  FROM documents d JOIN fx_tests t USING (doc_id))"""


@register("json_salvage", with_text("SELECT doc_id, problem, tests_text, n_tests FROM fx_expected", SALVAGE_EXPECTED))
def q_json_salvage(spark, sf):
    r = sv.parse_responses(fx_responses(spark, sf).select("doc_id", "response"), "response")
    return r.select("doc_id", "problem", _join_tests(F.col("tests")).alias("tests_text"), _n(F.col("tests")).alias("n_tests"))


#: Nine broken or unusual shapes around a document's text and two of its tests, and what is left of each.
SALVAGE_SHAPES = [
    ('{{"meta": {{"a": [1, {{"b": "x"}}], "n": null}}, "question": {q}, "tests": [{t1}, {t2}, "cut', "q", "both"),
    ('{{"question": "old", "tests": ["o"], "question": {q}, "tests": [{t1}, {t2}', "q", "both"),
    ('{{"tests": ["o"], "question": "old", "tests": [{t1}], "question": {q}}}', "q", "one"),
    ('{{"question": {q}, "tests": [{t1}, 12, true, null, {t2}, tru', "q", "mixed"),
    ('{{"question": {q}, "tests": [{t1}], "n": 5', "q", "one"),
    ('{{"tests": [{t1}], "question": {q}', "error", "one"),
    ('{{"question": {q}, "tests": [{t1}, {t2}], "notes": ["n1", [2], "n2', "q", "both"),
    ('Sure: {{"question": {q}, "tests": [{t1}]}}', "null", "none"),
    ('{{"question": {q}, "tests": [{t1} {t2}]}}', "q", "one"),
]
SHAPE_CASE = lambda k: " ".join(f"WHEN {i} THEN '{shape[k]}'" for i, shape in enumerate(SALVAGE_SHAPES))


@register(
    "salvage_shapes",
    with_text(
        f"""SELECT doc_id, CASE qs WHEN 'q' THEN text WHEN 'error' THEN 'Error in question generation' ELSE 'null' END AS problem,
                  CASE ts WHEN 'both' THEN t1 || '{TEST_SEP}' || t2 WHEN 'one' THEN t1
                          WHEN 'mixed' THEN t1 || '{TEST_SEP}12{TEST_SEP}true{TEST_SEP}' || t2 END AS tests_text,
                  CAST(CASE ts WHEN 'both' THEN 2 WHEN 'one' THEN 1 WHEN 'mixed' THEN 5 END AS BIGINT) AS n_tests
           FROM (SELECT *, CASE doc_id % {len(SALVAGE_SHAPES)} {SHAPE_CASE(1)} END AS qs, CASE doc_id % {len(SALVAGE_SHAPES)} {SHAPE_CASE(2)} END AS ts
                 FROM documents JOIN fx_tests USING (doc_id))"""
    ),
)
def q_salvage_shapes(spark, sf):
    """H2 on nested members, repeated keys, mixed lists, errors outside the tests, prose and missing commas."""
    r = fx_responses(spark, sf)
    quoted = lambda c: F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)")
    tests = _fx_tests(F.col("doc_id"), F.col("n_chars"), F.col("lang"), F.col("source"))
    r = r.withColumns({"t1": tests[0], "t2": tests[1]}).withColumns({"q_json": quoted("text"), "t1_json": quoted("t1"), "t2_json": quoted("t2")})
    kind = F.col("doc_id") % len(SALVAGE_SHAPES)
    shaped = F.lit(None).cast("string")
    for i, (shape, _, _) in enumerate(SALVAGE_SHAPES):
        pieces = re.split(r"(\x01|\x02|\x03)", shape.format(q="\x01", t1="\x02", t2="\x03"))
        held = {"\x01": F.col("q_json"), "\x02": F.col("t1_json"), "\x03": F.col("t2_json")}
        shaped = F.when(kind == i, F.concat(*[held.get(x, F.lit(x)) for x in pieces])).otherwise(shaped)
    out = sv.parse_responses(r.select("doc_id", shaped.alias("response")), "response")
    return out.select("doc_id", "problem", _join_tests(F.col("tests")).alias("tests_text"), _n(F.col("tests")).alias("n_tests"))


@register("valid_responses", with_text("SELECT doc_id, n_tests FROM fx_expected WHERE k < 4", SALVAGE_EXPECTED))
def q_valid_responses(spark, sf):
    r = sv.parse_responses(fx_responses(spark, sf).select("doc_id", "response"), "response")
    return r.where(sv.is_valid_response(F.col("response"), F.col("tests"))).select("doc_id", _n(F.col("tests")).alias("n_tests"))


@register(
    "sentinel_fill",
    with_text(
        """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'assert False' ELSE coalesce(tests_text, 'assert False') END AS tests_text,
                  CASE WHEN doc_id % 7 = 0 THEN 1 ELSE coalesce(n_tests, 1) END AS n_tests FROM fx_expected""",
        SALVAGE_EXPECTED,
    ),
)
def q_sentinel_fill(spark, sf):
    r = sv.parse_responses(fx_responses(spark, sf).select("doc_id", "response"), "response")
    # every seventh list is emptied: an empty list is filled like a missing one
    filled = sv.fill_sentinel(F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("tests")))
    return r.select("doc_id", _join_tests(filled).alias("tests_text"), _n(filled).alias("n_tests"))


@register(
    "think_strip",
    with_text(
        """SELECT problem_id, solution_id,
                  CASE WHEN strpos(raw_text, '</think>') > 0 THEN substr(raw_text, strpos(raw_text, '</think>') + 8) ELSE raw_text END AS stripped
           FROM fx_raw_turns""",
        RAW_TURN,
    ),
)
def q_think_strip(spark, sf):
    return fx_turns(spark, sf).select(P, S, tx.think_strip("raw_text").alias("stripped"))


@register(
    "code_block",
    with_text(
        f"""SELECT problem_id, solution_id, first_block, last_block, n_lines,
                  CASE WHEN n_lines > 500 THEN raw_text ELSE last_block END AS guarded
           FROM (SELECT problem_id, solution_id, raw_text,
                        CASE v WHEN 2 THEN {NL} || text || {NL}
                               WHEN 3 THEN {NL} || 'x = ' || CAST(turn AS VARCHAR) || {NL} || 'print(x)' || {NL}
                               ELSE '' END AS first_block,
                        CASE v WHEN 2 THEN {NL} || text || {NL}
                               WHEN 3 THEN {NL} || text || {NL} || '    printer = 1' || {NL}
                               ELSE raw_text END AS last_block,
                        CAST(len(string_split(raw_text, {NL})) AS BIGINT) AS n_lines
                 FROM fx_raw_turns)""",
        RAW_TURN,
    ),
)
def q_code_block(spark, sf):
    t = fx_turns(spark, sf)
    return t.select(
        P,
        S,
        tx.first_code_block("raw_text").alias("first_block"),
        tx.last_code_block("raw_text").alias("last_block"),
        tx.line_count("raw_text").cast("long").alias("n_lines"),
        tx.guarded_code("raw_text").alias("guarded"),
    )


@register(
    "code_blocks",
    with_text(
        f"""SELECT problem_id, solution_id, CAST(len(b) AS BIGINT) AS n_blocks,
                  CASE WHEN len(b) = 0 THEN '' ELSE trim(b[1], ' ' || {NL}) END AS first_code,
                  CASE WHEN len(b) = 0 THEN '' ELSE trim(b[len(b)], ' ' || {NL}) END AS last_code,
                  CASE WHEN len(b) = 0 THEN '' ELSE trim(array_to_string(b, {NL}), ' ' || {NL}) END AS all_code
           FROM (SELECT problem_id, solution_id, regexp_extract_all(raw_text, '(?s)```\\n?python(.*?)```', 1) AS b FROM fx_raw_turns)""",
        RAW_TURN,
    ),
)
def q_code_blocks(spark, sf):
    t = fx_turns(spark, sf)
    return t.select(
        P,
        S,
        F.size(tx.code_blocks("raw_text")).cast("long").alias("n_blocks"),
        tx.parse_code("raw_text", "first").alias("first_code"),
        tx.parse_code("raw_text", "last").alias("last_code"),
        tx.parse_code("raw_text", "all").alias("all_code"),
    )


@register(
    "strip_prints",
    with_text(
        f"""SELECT problem_id, solution_id,
                  array_to_string(list_filter(string_split(raw_text, {NL}), lambda l: NOT starts_with(trim(l), 'print')), {NL}) AS code
           FROM fx_raw_turns""",
        RAW_TURN,
    ),
)
def q_strip_prints(spark, sf):
    return fx_turns(spark, sf).select(P, S, tx.strip_prints("raw_text").alias("code"))


@register(
    "problem_text",
    with_text(
        f"""SELECT id, source,
                  CASE WHEN starter_code IS NOT NULL AND length(starter_code) > 0
                       THEN question || {NL} || {NL} || 'Here is the starter code:' || {NL} || starter_code
                       ELSE question END AS problem
           FROM fx_problems"""
    ),
)
def q_problem_text(spark, sf):
    p = fx_problems(spark, sf)
    return p.select("id", tx.source_tag("id").alias("source"), tx.problem_text("question", "starter_code").alias("problem"))


@register(
    "unwrap_fence",
    with_text("SELECT id, CASE WHEN source = 'bench' THEN unwrapped ELSE solution END AS program FROM fx_problems"),
)
def q_unwrap_fence(spark, sf):
    p = fx_problems(spark, sf)
    return p.select("id", tx.source_conditional("source", F.col("solution"), ("bench",), tx.unwrap_fence).alias("program"))


@register("union_sources", with_text("SELECT id, source, key FROM fx_problems"))
def q_union_sources(spark, sf):
    return fx_problems(spark, sf).select("id", "source", "key")


@register(
    "content_hash",
    with_text(
        f"""SELECT id, sha256(CASE WHEN starter_code IS NOT NULL AND length(starter_code) > 0
                                THEN question || {NL} || {NL} || 'Here is the starter code:' || {NL} || starter_code
                                ELSE question END) AS hash_id,
                  sha256(coalesce(solution, '')) AS solution_hash
           FROM fx_problems"""
    ),
)
def q_content_hash(spark, sf):
    p = fx_problems(spark, sf)
    return p.select(
        "id",
        F.sha2(tx.problem_text("question", "starter_code"), 256).alias("hash_id"),
        F.sha2(F.coalesce("solution", F.lit("")), 256).alias("solution_hash"),
    )


#: A message's text as ASCII JSON in DuckDB, character by character.
ESCAPED = """list_aggregate(list_transform(string_split({0}, ''), lambda c:
  CASE WHEN c = '"' THEN '\\"' WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
       WHEN unicode(c) BETWEEN 32 AND 126 THEN c
       WHEN unicode(c) > 65535 THEN printf('\\u%04x', 55296 + (unicode(c) - 65536) // 1024) || printf('\\u%04x', 56320 + (unicode(c) - 65536) % 1024)
       ELSE printf('\\u%04x', unicode(c)) END), 'string_agg', '')"""


@register(
    "messages_hash",
    f"""WITH m AS (SELECT conv_id, turn, '{{"content":"' || coalesce({ESCAPED.format("text || chr(9) || chr(128512)")}, '') || '","role":"' || role || '"}}' AS j FROM conversations)
        SELECT conv_id, sha256('[' || string_agg(j, ',' ORDER BY turn) || ']') AS hash_id, count(*) AS n_messages FROM m GROUP BY conv_id""",
)
def q_messages_hash(spark, sf):
    """H4 (messages): the key of every conversation; each text gets a tab and a character beyond the first plane."""
    c = read_table(spark, sf, "conversations")
    message = F.struct("turn", F.concat("text", F.lit("\t\U0001f600")).alias("content"), "role")
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return rows.select("conv_id", messages_key("messages").alias("hash_id"), F.size("messages").cast("long").alias("n_messages"))


@register(
    "pretty_name",
    "SELECT page_id, replace(string_split(url, '/')[-1], '-', '_') AS name FROM pages",
)
def q_pretty_name(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", tx.pretty_name("url").alias("name"))


PRETTY_SQL = r"""
WITH a AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://', ''), '^[^/]+\.com/', ''), '^[^/]+\.org/', '') AS x
  FROM pages),
b AS (
  SELECT page_id, url, x, list_filter(string_split(x, '/'), lambda p: trim(p) <> '') AS parts FROM a),
c AS (
  SELECT page_id, url,
         CASE WHEN strpos(x, '/') > 0 AND len(parts) > 0 THEN
              CASE WHEN strpos(parts[-1], '.') > 0 AND NOT starts_with(parts[-1], '.')
                   THEN regexp_replace(parts[-1], '\.[^.]*$', '') ELSE parts[-1] END
              ELSE x END AS y
  FROM b),
d AS (
  SELECT page_id, url,
         regexp_replace(
           regexp_replace(
             regexp_replace(
               regexp_replace(replace(replace(y, '/', '_'), '\', '_'), '[-\s]+', '_', 'g'),
             '[^\w\-_.]', '_', 'g'),
           '_+', '_', 'g'),
         '^[_.]+|[_.]+$', '', 'g') AS z
  FROM c),
e AS (
  SELECT page_id, url, CASE WHEN regexp_matches(z, '^[0-9]') THEN 'model_' || z ELSE z END AS w FROM d)
SELECT page_id,
       CASE WHEN url IS NULL OR url = '' OR w = '' THEN 'unnamed'
            WHEN length(w) > 100 THEN regexp_replace(left(w, 100), '[_.]+$', '')
            ELSE w END AS name
FROM e
"""


@register("pretty_name_full", PRETTY_SQL)
def q_pretty_name_full(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", tx.pretty_name_full("url").alias("name"))


@register(
    "truncate_mid",
    """SELECT doc_id,
              CASE WHEN length(text) <= 300 THEN text ELSE left(text, 150) || '...(truncated) ...' || right(text, 150) END AS short_text,
              CAST(floor(300 / len(string_split(text, chr(10)))) AS INTEGER) AS line_budget
       FROM documents""",
)
def q_truncate_mid(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", tx.truncate_mid("text", 300).alias("short_text"), tx.line_budget("text").alias("line_budget"))


@register(
    "error_text",
    """SELECT doc_id,
              CASE WHEN trim(left(text, 256), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN NULL ELSE left(text, 256) END AS error,
              'Traceback (most recent call last):' || chr(10) || '  ' ||
              CASE WHEN doc_id % 2 = 0 THEN 'File "<string>", line ' || CAST(doc_id AS VARCHAR) || chr(10) || text
                   ELSE text END AS traceback
       FROM documents""",
)
def q_error_text(spark, sf):
    d = read_table(spark, sf, "documents")
    tb = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit('junk\nFile "<string>", line '), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")),
    ).otherwise(F.col("text"))
    return d.select("doc_id", tx.error_text("text").alias("error"), tx.clean_traceback(tb).alias("traceback"))


ASSERTS = """fx_asserts AS (
  SELECT doc_id, 1 AS which, 'f' AS entry, CAST(doc_id AS VARCHAR) AS input, CAST(n_chars AS VARCHAR) AS expected FROM documents
  UNION ALL SELECT doc_id, 2, 'g', '"' || lang || '", "a\\nb"', '"' || source || '"' FROM documents
  UNION ALL SELECT doc_id, 3, 'h', CAST(n_chars AS VARCHAR), 'True' FROM documents)"""


@register("assert_parts", with_text("SELECT doc_id, CAST(which AS BIGINT) AS which, entry, input, expected FROM fx_asserts", ASSERTS))
def q_assert_parts(spark, sf):
    d = read_table(spark, sf, "documents")
    from ..fixtures import _fx_tests

    tests = F.array(*_fx_tests(F.col("doc_id"), F.col("n_chars"), F.col("lang"), F.col("source")))
    e = d.select("doc_id", F.posexplode(tests).alias("i", "t"))
    inp, out = tx.assert_parts(F.col("t"))
    return e.select(
        "doc_id", (F.col("i") + 1).cast("long").alias("which"), tx.assert_entry_point("t").alias("entry"),
        inp.alias("input"), out.alias("expected"),
    )


@register(
    "render_matrix",
    with_fx(
        """SELECT problem_id, '[' || chr(10) || string_agg('    ' || row || ',', chr(10) ORDER BY solution_id) || chr(10) || ']' AS matrix
           FROM (SELECT problem_id, solution_id,
                        '[' || string_agg(CASE WHEN pass THEN 'True' ELSE 'False' END, ', ' ORDER BY test_id) || ']' AS row
                 FROM fx_outcomes GROUP BY 1, 2)
           GROUP BY 1"""
    ),
)
def q_render_matrix(spark, sf):
    o = fx_outcomes(spark, sf)
    rows = o.groupBy(P, S).agg(
        tx.render_bool_list(F.transform(F.sort_array(F.collect_list(F.struct(T, "pass"))), lambda x: x["pass"])).alias("row")
    )
    m = rows.groupBy(P).agg(F.sort_array(F.collect_list(F.struct(S, "row"))).alias("rows"))
    return m.select(P, tx.render_rows(F.transform("rows", lambda x: x["row"])).alias("matrix"))


# user templates (wording is the user's; these are small examples)
TEMPLATE_WITH = "Question:\n{question}\n\nReference program:\n{program}\n\nWrite tests."
TEMPLATE_WITHOUT = "Question:\n{question}\n\nWrite tests."


@register(
    "render_prompt",
    with_text(
        f"""SELECT id,
                  CASE WHEN program IS NULL
                       THEN replace('{TEMPLATE_WITHOUT.replace(chr(10), "' || chr(10) || '")}', '{{question}}', coalesce(problem, ''))
                       ELSE replace(replace('{TEMPLATE_WITH.replace(chr(10), "' || chr(10) || '")}', '{{question}}', coalesce(problem, '')),
                                    '{{program}}', coalesce(program, '')) END AS prompt
           FROM (SELECT id,
                        CASE WHEN starter_code IS NOT NULL AND length(starter_code) > 0
                             THEN question || {NL} || {NL} || 'Here is the starter code:' || {NL} || starter_code
                             ELSE question END AS problem,
                        CASE WHEN source = 'bench' THEN unwrapped ELSE solution END AS program
                 FROM fx_problems)"""
    ),
)
def q_render_prompt(spark, sf):
    p = fx_problems(spark, sf).select(
        "id",
        tx.problem_text("question", "starter_code").alias("problem"),
        tx.source_conditional("source", F.col("solution"), ("bench",), tx.unwrap_fence).alias("program"),
    )
    with_prog = tx.render_prompt(TEMPLATE_WITH, question=F.col("problem"), program=F.col("program"))
    without = tx.render_prompt(TEMPLATE_WITHOUT, question=F.col("problem"))
    return p.select("id", F.when(F.col("program").isNull(), without).otherwise(with_prog).alias("prompt"))


@register(
    "time_limits",
    with_fx(
        """SELECT problem_id, solution_id, least(15.0, sum(greatest(1.0, 1.0 * time_limit))) + 1.0 AS budget
           FROM fx_details GROUP BY 1, 2"""
    ),
)
def q_time_limits(spark, sf):
    from ..fixtures import fx_outcome_details

    d = fx_outcome_details(spark, sf).withColumn("limit", tx.time_limit("time_limit", 1.0, 1.0))
    return d.groupBy(P, S).agg((F.least(F.lit(15.0), F.sum("limit")) + F.lit(1.0)).alias("budget"))


# ---------------------------------------------------------------- row selection by a stated order

ORDERED = """fx_ordered AS (
  SELECT id, source, key, row_number() OVER (ORDER BY CASE source WHEN 'bench' THEN 0 ELSE 1 END, key) - 1 AS i FROM fx_problems)"""


@register(
    "stratified_head",
    with_text(
        """SELECT id, source, key FROM (
             SELECT id, source, key, row_number() OVER (PARTITION BY source ORDER BY key) AS rn FROM fx_problems)
           WHERE rn <= CASE source WHEN 'bench' THEN 13 ELSE 12 END"""
    ),
)
def q_stratified_head(spark, sf):
    from ..operators.sampling import stratified_head

    return stratified_head(fx_problems(spark, sf), "source", ["bench", "docs"], "key", 25).select("id", "source", "key")


@register(
    "seeded_sample",
    with_text(
        """SELECT id, source, key FROM (
             SELECT id, source, key, row_number() OVER (ORDER BY md5(concat_ws('|', '42', id))) AS rn FROM fx_problems)
           WHERE rn <= 50"""
    ),
)
def q_seeded_sample(spark, sf):
    from ..operators.sampling import seeded_sample

    return seeded_sample(fx_problems(spark, sf), "id", 50, seed=42).select("id", "source", "key")


@register("row_slice", with_text("SELECT id, source, key, CAST(i AS BIGINT) AS i FROM fx_ordered WHERE i >= 10 AND i < 60", ORDERED))
def q_row_slice(spark, sf):
    from ..operators.sampling import row_index

    p = fx_problems(spark, sf).withColumn("_src_rank", F.when(F.col("source") == "bench", 0).otherwise(1))
    r = row_index(p, ["_src_rank", "key"], "i")
    return r.where((F.col("i") >= 10) & (F.col("i") < 60)).select("id", "source", "key", "i")


@register(
    "fill_id",
    with_text(
        """SELECT key, source, coalesce(CASE WHEN key % 4 = 0 THEN NULL ELSE id END,
                                        CASE WHEN key % 8 = 0 THEN NULL ELSE 'nested_' || CAST(key AS VARCHAR) END,
                                        'item_' || CAST(i AS VARCHAR)) AS filled_id
           FROM fx_ordered""",
        ORDERED,
    ),
)
def q_fill_id(spark, sf):
    from ..operators.sampling import fill_id

    p = fx_problems(spark, sf).withColumn("_src_rank", F.when(F.col("source") == "bench", 0).otherwise(1))
    p = p.select(
        "key", "source", "_src_rank",
        F.when(F.col("key") % 4 == 0, F.lit(None)).otherwise(F.col("id")).alias("id"),
        F.when(F.col("key") % 8 == 0, F.lit(None)).otherwise(F.concat(F.lit("nested_"), F.col("key").cast("string"))).alias("nested_id"),
    )
    return fill_id(p, "id", "nested_id", ["_src_rank", "key"]).select("key", "source", "filled_id")


@register(
    "batch_assign",
    with_text("SELECT id, CAST(floor(i / 64) AS BIGINT) AS batch FROM fx_ordered", ORDERED),
)
def q_batch_assign(spark, sf):
    from ..operators.sampling import batch_assign

    p = fx_problems(spark, sf).withColumn("_src_rank", F.when(F.col("source") == "bench", 0).otherwise(1))
    return batch_assign(p, ["_src_rank", "key"], 64).select("id", "batch")


@register(
    "point_lookup",
    with_text("SELECT id, source, key, question FROM fx_problems WHERE id = 'docs_7'"),
)
def q_point_lookup(spark, sf):
    return fx_problems(spark, sf).where(F.col("id") == "docs_7").select("id", "source", "key", "question")

