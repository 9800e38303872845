"""Fill-in-middle forms of texts, cut at units by one counted-quantifier match.

``regexp_count`` gives the number n of units of a text.  Two seeded draws in
0..n are the cuts a <= b, and the row's own pattern

    \\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z

captures prefix, middle and suffix in one match.  The counted groups are
possessive: a unit that has matched is never given back, so the match is one
left-to-right walk without recursion, whatever the number of units.  The
replacement string of the same call lays the captured parts out in the chosen
form, so the text is matched once and nothing is cut by position.

A text that holds no marker can be read back from its output: the markers
stand in it exactly once each, so splitting at them gives the parts.

All work is row-local column functions: no shuffle, no Python.

Defined results: null text counts as empty; an empty text, a text that holds a
marker and a text not drawn are plain; a null id draws like the empty id; one
unit of any length and any number of units are cut like others; equal (id,
text) rows get equal results; empty tables give no rows; other columns are
ignored unless named in ``keep`` (a kept name that is also a result's name is
an error).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its line feed, or the rest of the text without one.
LINES = r"[^\n]*+\n|[^\n]++"
#: A run of white space with the word after it.
WORDS = r"\s*+\S++|\s++"

MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ("n_units", "form", "output", "prefix_chars", "middle_chars")


def draws(id_col: str, seed: str) -> list[Column]:
    """The first four 32-bit numbers of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _parts(output: Column, markers: Sequence[str]) -> Column:
    """What stands before, between and after the markers, in the order of the output."""
    return F.split(output, "|".join(re.escape(m) for m in markers), -1)


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The exact text from an output and its form."""
    part = _parts(output, markers)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", unit: str = LINES,
    seed: str = "7", percent: int = 100, spm_percent: int = 50, markers: Sequence[str] = MARKERS,
) -> DataFrame:
    """``keep`` columns, n_units, form (plain, psm, spm), output, prefix_chars, middle_chars (code points; null if plain).

    ``unit`` is a pattern whose matches tile every text from left to right;
    ``percent`` of the texts are transformed, ``spm_percent`` of these get the
    suffix first.
    """
    if clash := set(keep) & set(RESULTS):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    prefix, suffix, middle = (m.replace("\\", "\\\\").replace("$", "\\$") for m in markers)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    cut = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), text, F.array(*draws(id_col, seed)).alias("h"))
    cut = cut.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    marked = reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in markers])
    form = F.when((F.col("text") == "") | marked | (F.col("h")[2] % 100 >= percent), "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col("h")[k] % (F.col("n") + 1) for k in (0, 1)]
    cut = cut.withColumns({"form": form, "a": F.least(*cuts), "b": F.greatest(*cuts)})
    pattern = F.concat(F.lit(rf"\A((?:{unit}){{"), F.col("a"), F.lit(rf"}}+)((?:{unit}){{"), F.col("b") - F.col("a"), F.lit(r"}+)((?s:.*+))\z"))
    layout = F.when(F.col("form") == "psm", f"{prefix}$1{suffix}$3{middle}$2").otherwise(f"{suffix}$3{prefix}$1{middle}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, layout))
    cut = cut.withColumn("output", output).withColumn("part", _parts(F.col("output"), markers))
    before = F.when(F.col("form") == "psm", F.col("part")[1]).when(F.col("form") == "spm", F.col("part")[2])
    return cut.select(
        "kept.*", F.col("n").alias("n_units"), "form", "output", F.length(before).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length(F.col("part")[3])).cast("long").alias("middle_chars"),
    )
