"""The request-parameter record kept with each generated response (provenance).

Models whose name starts with ``o`` take no temperature / top_p; a seed is
recorded only when one was set.  The record is a struct column, so it can be
stored next to the response in the cache table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_params(model: Column, temperature: Column, top_p: Column, max_tokens: Column, seed: Column) -> Column:
    """``struct<model, temperature, top_p, max_completion_tokens, seed>`` with the rules above."""
    plain = ~model.startswith("o")
    return F.struct(
        model.alias("model"),
        F.when(plain, temperature.cast("double")).alias("temperature"),
        F.when(plain, top_p.cast("double")).alias("top_p"),
        max_tokens.cast("long").alias("max_completion_tokens"),
        seed.cast("long").alias("seed"),
    )
