"""Column -> Column text functions.

All are built from Spark's JVM string functions, so they stay inside
whole-stage codegen and process the whole text of every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# fixed values
FENCE_PY = "```python"
FENCE = "```"
THINK_END = "</think>"
STARTER_LABEL = "\n\nHere is the starter code:\n"
LINE_GUARD = 500  # texts with more lines than this skip code extraction
# Python's str.splitlines() boundaries and str.strip() whitespace (Java regex classes)
LINE_BREAKS = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
WS = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def py_strip(s: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(s), f"^{WS}+|{WS}+$", "")


def strip_chars(s: Column | str, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a small literal set of characters."""
    cls = "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)
    cls = cls.replace("\n", "\\n")
    return F.regexp_replace(_c(s), f"^[{cls}]+|[{cls}]+$", "")


def split_lines(s: Column | str) -> Column:
    """Python ``str.splitlines()``: no trailing empty element after a final line break."""
    s = _c(s)
    parts = F.split(s, LINE_BREAKS, -1)
    ends_with_break = s.rlike(f"({LINE_BREAKS})$")
    n = F.size(parts)
    return (
        F.when(s == "", F.array().cast("array<string>"))
        .when(ends_with_break, F.slice(parts, 1, n - 1))
        .otherwise(parts)
    )


def after_first(s: Column | str, marker: str) -> Column:
    """Text after the first occurrence of ``marker`` (null when absent)."""
    s = _c(s)
    pos = F.locate(marker, s)
    return F.when(pos > 0, s.substr(pos + F.lit(len(marker)), F.lit(2147483647)))


def think_strip(s: Column | str) -> Column:
    """H8: keep the text after the first ``</think>``; all of it when there is none."""
    s = _c(s)
    return F.coalesce(after_first(s, THINK_END), s)


def first_code_block(s: Column | str) -> Column:
    """H1: text of the first ```python block; "" when unopened or unclosed."""
    rest = after_first(s, FENCE_PY)
    end = F.locate(FENCE, rest)
    return F.when(rest.isNull() | (end == 0), F.lit("")).otherwise(rest.substr(F.lit(1), end - 1))


def last_code_block(s: Column | str) -> Column:
    """``split('```python')[-1].split('```')[0]`` -- the whole text if there is no fence."""
    tail = F.substring_index(_c(s), FENCE_PY, -1)
    return F.substring_index(tail, FENCE, 1)


def line_count(s: Column | str) -> Column:
    """Number of lines as ``len(s.split('\\n'))``."""
    return F.size(F.split(_c(s), "\n", -1))


def guarded_code(s: Column | str, extract=last_code_block, max_lines: int = LINE_GUARD) -> Column:
    """Extract code unless the text has more than ``max_lines`` lines (then the raw text)."""
    s = _c(s)
    return F.when(line_count(s) > max_lines, s).otherwise(extract(s))


TAG_BLOCK = r"(?s)<python>(.*?)</python>"
FENCE_BLOCK = r"(?s)```\n?python(.*?)```"


def code_blocks(s: Column | str) -> Column:
    """H9: all code blocks -- ``<python>`` tags if any, else python fences (array, in order)."""
    s = _c(s)
    tags = F.regexp_extract_all(s, F.lit(TAG_BLOCK), 1)
    fences = F.regexp_extract_all(s, F.lit(FENCE_BLOCK), 1)
    return F.when(F.size(tags) > 0, tags).otherwise(fences)


LAST_TURN = "<|im_start|>assistant"


def parse_code(s: Column | str, mode: str = "all", valid: Column | None = None) -> Column:
    """H9: join blocks per ``mode`` (all / first / last / all_in_last_turn), trimmed of spaces and newlines.

    ``valid`` is an optional user hook: a function block -> boolean Column used by
    the ``all`` modes to keep syntactically valid blocks only.
    """
    s = _c(s)
    if mode == "all_in_last_turn":
        last = F.substring_index(s, LAST_TURN, -1)
        s = F.when(F.locate(LAST_TURN, s) > 0, F.concat(F.lit(LAST_TURN), last)).otherwise(s)
        mode = "all"
    blocks = code_blocks(s)
    if mode == "all":
        kept = F.filter(blocks, valid) if valid is not None else blocks
        joined = F.array_join(kept, "\n")
    elif mode == "first":
        joined = F.element_at(blocks, 1)
    elif mode == "last":
        joined = F.element_at(blocks, -1)
    else:
        raise ValueError(f"invalid mode {mode}")
    return F.when(F.size(blocks) == 0, F.lit("")).otherwise(strip_chars(joined, " \n"))


def strip_prints(s: Column | str) -> Column:
    """H3: drop every line whose stripped text starts with ``print``."""
    lines = split_lines(s)
    return F.array_join(F.filter(lines, lambda ln: ~py_strip(ln).startswith("print")), "\n")


def unwrap_fence(s: Column | str) -> Column:
    """Remove a leading ```python / ``` fence (and following newlines); then a trailing
    ``` (and preceding newlines) only if a leading fence was removed."""
    s = _c(s)

    def tail(x: Column) -> Column:
        return F.when(x.endswith(FENCE), F.regexp_replace(x.substr(F.lit(1), F.length(x) - 3), "\n+$", "")).otherwise(x)

    py = F.regexp_replace(s.substr(F.lit(len(FENCE_PY) + 1), F.lit(2147483647)), "^\n+", "")
    bare = F.regexp_replace(s.substr(F.lit(len(FENCE) + 1), F.lit(2147483647)), "^\n+", "")
    return F.when(s.startswith(FENCE_PY), tail(py)).when(s.startswith(FENCE), tail(bare)).otherwise(s)


def source_tag(id_col: Column | str) -> Column:
    """B2: the source is the id before its first ``_``."""
    return F.split_part(_c(id_col), F.lit("_"), F.lit(1))


def problem_text(question: Column | str, starter: Column | str) -> Column:
    """B1: question, plus the labelled starter code when that is non-empty."""
    q, st = _c(question), _c(starter)
    return F.when(st.isNotNull() & (F.length(st) > 0), F.concat(q, F.lit(STARTER_LABEL), st)).otherwise(q)


def source_conditional(source: Column | str, value: Column, sources: tuple[str, ...], fn) -> Column:
    """Apply ``fn`` to ``value`` only for rows of the given sources."""
    return F.when(_c(source).isin(*sources), fn(value)).otherwise(value)


def pretty_name(s: Column | str) -> Column:
    """H6: the part after the last ``/`` with ``-`` turned into ``_``."""
    return F.replace(F.element_at(F.split(_c(s), "/", -1), -1), F.lit("-"), F.lit("_"))


def pretty_name_full(s: Column | str) -> Column:
    """H7: file-safe name of a model / dataset / URL / path.

    Steps in order: strip; drop URL scheme, then a leading ``*.com/`` and
    ``*.org/`` host; if a ``/`` remains take the last non-blank path part and
    drop its extension (unless it starts with a dot); map separators and other
    characters to ``_``; squeeze ``_``; trim ``_`` and ``.``; prefix ``model_``
    when it starts with a digit; cut to 100 characters (trimming ``_``/``.``).
    Empty -> ``unnamed``.
    """
    x = py_strip(s)
    x = F.regexp_replace(x, "^https?://", "")
    x = F.regexp_replace(x, "^[^/]+\\.com/", "")
    x = F.regexp_replace(x, "^[^/]+\\.org/", "")
    parts = F.filter(F.split(x, "/", -1), lambda p: py_strip(p) != "")
    last = F.element_at(parts, -1)
    no_ext = F.when(
        F.locate(".", last) > 0,
        F.when(last.startswith("."), last).otherwise(F.regexp_replace(last, "(?<=.)\\.[^.]*$", "")),
    ).otherwise(last)
    x = F.when(F.locate("/", x) > 0, F.when(F.size(parts) > 0, no_ext).otherwise(x)).otherwise(x)
    x = F.replace(x, F.lit("/"), F.lit("_"))
    x = F.replace(x, F.lit("\\"), F.lit("_"))
    x = F.regexp_replace(x, "(?U)[-\\s]+", "_")
    x = F.regexp_replace(x, "(?U)[^\\w\\-_.]", "_")
    x = F.regexp_replace(x, "_+", "_")
    x = F.regexp_replace(x, "^[_.]+|[_.]+$", "")
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("model_"), x)).otherwise(x)
    x = F.when(F.length(x) > 100, F.regexp_replace(F.substring(x, 1, 100), "[_.]+$", "")).otherwise(x)
    raw = _c(s)
    return F.when(raw.isNull() | (raw == "") | (x == ""), F.lit("unnamed")).otherwise(x)


def truncate_mid(s: Column | str, length: int = 300) -> Column:
    """``head + '...(truncated) ...' + tail`` when longer than ``length``
    (head = length // 2 characters, tail = the last ceil(length / 2))."""
    s = _c(s)
    head, tail = length // 2, -((-length) // 2)
    return F.when(F.length(s) <= length, s).otherwise(
        F.concat(F.substring(s, 1, head), F.lit("...(truncated) ..."), F.substring(s, -tail, tail))
    )


def line_budget(s: Column | str, total: int = 300) -> Column:
    """Per-line budget ``total // (newlines + 1)``."""
    n = F.size(F.split(_c(s), "\n", -1))
    return F.floor(F.lit(total) / n).cast("int")


def error_text(s: Column | str, width: int = 256) -> Column:
    """Error text cut to ``width`` characters; blank -> null."""
    cut = F.substring(_c(s), 1, width)
    return F.when(py_strip(cut) == "", F.lit(None).cast("string")).otherwise(cut)


TRACE_HEAD = "Traceback (most recent call last):\n  "
TRACE_FILE = 'File "<string>"'


def clean_traceback(s: Column | str) -> Column:
    """Keep the traceback from ``File "<string>"`` under a fresh header; without the
    marker the whole text follows the header."""
    s = _c(s)
    pos = F.locate(TRACE_FILE, s)
    body = F.when(pos > 0, s.substr(pos, F.lit(2147483647))).otherwise(s)
    return F.concat(F.lit(TRACE_HEAD), body)


def assert_entry_point(t: Column | str) -> Column:
    """The text between ``assert `` and the first ``(`` (null without ``assert ``).

    Slice semantics as the reference: an end before the start gives "", no
    ``(`` at all cuts before the last character.
    """
    t = _c(t)
    a = F.locate("assert ", t)
    start = a + 7
    end = F.locate("(", t)
    stop = F.when(end == 0, F.length(t)).otherwise(end)
    return F.when(a == 0, F.lit(None).cast("string")).when(stop <= start, F.lit("")).otherwise(
        t.substr(start, stop - start)
    )


def assert_parts(t: Column | str) -> tuple[Column, Column]:
    """(input text, expected text) of ``assert f(args) == expected``; ``is`` when no ``==``.

    Input = between the first ``(`` and the last ``)`` before the operator end;
    expected = the stripped rest after the operator.
    """
    t = _c(t)
    eq = F.locate("==", t)
    # last 'is' when there is no '=='
    is_pos = F.length(t) - F.locate("si", F.reverse(t)) + 1 - 1
    op = F.when(eq > 0, eq).when(F.locate("is", t) > 0, is_pos)
    op_end = op + 2
    lparen = F.locate("(", t)
    head = t.substr(F.lit(1), op_end - 1)
    rparen = F.length(head) - F.locate(")", F.reverse(head)) + 1
    inp = py_strip(t.substr(lparen + 1, rparen - lparen - 1))
    out = py_strip(t.substr(op_end, F.lit(2147483647)))
    ok = (lparen > 0) & op.isNotNull() & (F.locate(")", head) > 0)
    return F.when(ok, inp), F.when(ok, out)


def time_limit(ref_time: Column | str, min_limit: float = 1.0, factor: float = 1.0) -> Column:
    """Per-test limit ``max(min_limit, factor * reference time)``."""
    return F.greatest(F.lit(float(min_limit)), F.lit(float(factor)) * _c(ref_time))


def task_budget(limits: Column | str, cap: float = 15.0, slack: float = 1.0) -> Column:
    """Per-solution budget ``min(cap, sum(limits)) + slack`` over an array of limits."""
    total = F.aggregate(_c(limits), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(cap), total) + F.lit(slack)


def render_bool_list(arr: Column | str) -> Column:
    """Python rendering of a list of booleans: ``[True, False]``."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(_c(arr), lambda b: F.when(b, "True").otherwise("False")), ", "), F.lit("]")
    )


def render_rows(rows: Column | str) -> Column:
    """``[`` + one ``    row,`` line per element + ``]`` (elements already rendered)."""
    return F.concat(F.lit("[\n"), F.array_join(F.transform(_c(rows), lambda r: F.concat(F.lit("    "), r, F.lit(","))), "\n"), F.lit("\n]"))


def render_prompt(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots of a user template with column values (replace chain)."""
    out = F.lit(template)
    for name, col in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col, F.lit("")))
    return out


def choose_template(program: Column | str, with_program: str, without_program: str) -> Column:
    """The template is chosen by a *null* program (an empty string counts as present)."""
    return F.when(_c(program).isNull(), F.lit(without_program)).otherwise(F.lit(with_program))
