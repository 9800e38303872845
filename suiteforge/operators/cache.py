"""Response cache keyed by content hash (C1-C4, E1, E2, B14) and the generation hook.

The cache is a table ``responses(hash_id, response, seq, ...)``; the newest
``seq`` per hash wins.  Attaching, finding pending work and splitting done
from not-done are joins, so reruns are idempotent: resume twice = run once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# fixed values: error texts stored by failed calls start with this prefix
ERROR_PREFIX = "ERROR:"
ERROR_CLASSES = [  # (class, prefix) checked in order
    ("rate_limit", "ERROR: Rate limit"),
    ("server", "ERROR: Server error"),
    ("http", "ERROR: HTTP "),
    ("timeout", "ERROR: Timeout"),
]


def error_class(response: Column | str) -> Column:
    """Class of a stored failure text; null for a real response."""
    r = F.col(response) if isinstance(response, str) else response
    out = F.when(~r.startswith(ERROR_PREFIX) | r.isNull(), F.lit(None).cast("string"))
    for name, prefix in ERROR_CLASSES:
        out = out.when(r.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit("other"))


def latest_responses(cache: DataFrame, key: str = "hash_id", seq: str = "seq", response: str = "response") -> DataFrame:
    """Last write wins per key (highest ``seq``; ties broken by the response text).

    A map-side-combined ``max_by`` -- a hot key never gathers its rows in one task.
    """
    cols = [c for c in cache.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(seq), F.col(response)))
    return cache.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def attach_cached(items: DataFrame, cache: DataFrame, key: str = "hash_id", retry_errors: bool = True) -> DataFrame:
    """Items with their cached response (left join on the content hash).

    ``cached`` is true when a usable response exists; with ``retry_errors`` a
    stored failure text does not count as usable.
    """
    latest = latest_responses(cache, key).select(key, "response", "seq")
    j = items.join(latest, key, "left")
    usable = F.col("response").isNotNull()
    if retry_errors:
        usable = usable & error_class("response").isNull()
    return j.withColumn("error_class", error_class("response")).withColumn("cached", usable)


def pending(items: DataFrame, cache: DataFrame, key: str = "hash_id", retry_errors: bool = True) -> DataFrame:
    """Items without a usable cached response (left anti join)."""
    latest = latest_responses(cache, key).select(key, "response")
    if retry_errors:
        latest = latest.where(error_class("response").isNull())
    return items.join(latest.select(key), key, "left_anti")


def mark_done(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """C4 in one pass: every item with ``done`` = whether an earlier run has its result."""
    d = done.select(key).distinct().withColumn("done", F.lit(True))
    return items.join(d, key, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def resume_split(items: DataFrame, done: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """C4: (already done, still to do) by id, both read from one marked pass."""
    m = mark_done(items, done, key)
    return m.where(F.col("done")).drop("done"), m.where(~F.col("done")).drop("done")


def completion_index(df: DataFrame, text: str, order: list[str], out: str = "occurrence") -> DataFrame:
    """Occurrence number (from 0) of each identical text, in the stated order.

    Identical copies can be a large share of all rows, so the numbering is the
    two-phase :func:`group_row_index` keyed by the text hash, never one window
    partition per text.
    """
    from .sampling import group_row_index

    h = df.withColumn("_h", F.sha2(F.col(text), 256))
    return group_row_index(h, ["_h"], order, out).drop("_h")


GeneratorFn = Callable[[pd.DataFrame], pd.DataFrame]


def generate_with(
    items: DataFrame,
    cache: DataFrame,
    fn: GeneratorFn,
    prompt: str = "prompt",
    key: str = "hash_id",
    retry_errors: bool = True,
    cost: str | None = None,
) -> DataFrame:
    """Run a user generator on pending prompts only, once per distinct hash.

    ``fn`` receives a pandas batch with ``hash_id`` and ``prompt`` and returns
    ``hash_id`` and ``response`` (failures as ``ERROR: ...`` text, which are
    cached like answers).  Returns the new cache rows (append them to the
    cache table); rows are spread by hash so slow prompts do not pile up, or
    by total ``cost`` (a column of ``items``, e.g. the prompt length).
    """
    cols = [key, prompt] + ([cost] if cost else [])
    todo = pending(items, cache, key, retry_errors).select(*cols).dropDuplicates([key])
    n = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cost:
        from .evaluate import cost_spread

        todo = cost_spread(todo, cost, n, group=(key,))
    else:
        todo = todo.repartition(n, key)
    next_seq = cache.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).select("s").scalar()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = fn(b[[key, prompt]])
            yield out[[key, "response"]]

    # stored before it is returned: writing the rows and joining them must not call the model twice
    new = cut_lineage(todo.mapInPandas(run, schema=f"{key} string, response string"))
    return new.withColumn("seq", (next_seq + 1).cast("long"))
