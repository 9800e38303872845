"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The target weights are whole numbers w with the sum W.  The documents of a
source, in seeded-hash order, form blocks of ``block_rows`` rows; its j-th
block (from 1) must get a slot between the release floor((j - 1) * W / w) and
the deadline ceil(j * W / w).  Earliest deadline first (ties: by source name)
meets all of them, so after every slot each source has had its weight's share
of the slots to within less than one block, for ever: release and deadline come
from the weights themselves, nothing is rounded on the way.

After W slots every source has had exactly w blocks, so the schedule of W slots
holds for all that follow: the sequential choice runs over W slots only,
whatever the number of documents, and every row finds its slot by arithmetic.
Stated weights that are whole numbers with a sum of at most ``parts`` are taken
as they are.  Others (and the default, a power of the sources' sizes) become
targets of whole parts: round(parts * weight / sum), at least one, so that W is
``parts`` give or take half the number of sources.

A row's position is slot * block_rows + place in the block: unique, and with
gaps only where a source has ended (its last, shorter block and the slots after
it).  Every row of every source is placed; the deviation bound holds as long as
all sources last, and the others keep their relative shares after that.

Numbering inside a source: the order is md5 of the id, so its first hex digits
split a source of any size into ``16 ** digits`` buckets numbered apart, and a
small table of bucket counts gives the offsets.

Defined results: a null source is a source of its own, first in name order; a
null id sorts as the empty text; texts are not read; equal ids are ordered by
their other columns, equal rows each get their own position; an empty table
gives no rows; a column named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096
BLOCK_ROWS = 32
DIGITS = 3


def source_key(source: Column) -> Column:
    """A non-null key: ``''`` for null, else ``=`` and the name."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def weight_of(n: Column, power: float = 0.5) -> Column:
    """Target weight from a source's row count: its ``power``, in whole thousandths."""
    return F.greatest(F.lit(1), F.floor(F.pow(n, F.lit(power)) * 1000)).cast("long")


def whole_parts(weights: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, weight) with whole weights in proportion to the given positive ones, their sum about ``parts``."""
    listed = weights.groupBy().agg(F.collect_list(F.struct("key", "weight")).alias("all"), F.sum("weight").alias("total"))
    return listed.select(F.inline(F.expr(f"transform(all, p -> named_struct('key', p.key, 'weight', greatest(1L, (2L * {parts} * p.weight + total) div (2 * total))))")))


def schedule(weights: DataFrame) -> DataFrame:
    """The slots of one period: (key, parts, period, slots) for (key, whole weight); the period is the sum of the weights."""
    listed = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("all"), F.sum("weight").cast("int").alias("period"))
    parts = listed.withColumn("all", F.expr("transform(all, (p, k) -> named_struct('k', k, 'key', p.key, 'parts', cast(p.weight as int)))"))
    # state: blocks given so far to each source; of the released next blocks, the earliest deadline wins, then the name
    earliest = """array_min(transform(all, p -> if(p.parts > s.given[p.k] and (s.given[p.k] * period) div p.parts <= t,
        ((s.given[p.k] + 1) * period + p.parts - 1) div p.parts * size(all) + p.k, null)))"""
    order = f"""aggregate(sequence(0, period - 1),
        named_struct('given', transform(all, p -> 0L), 'order', cast(array() as array<int>)),
        (s, t) -> transform(array(cast({earliest} % size(all) as int)),
            k -> named_struct('given', transform(s.given, (x, i) -> if(i = k, x + 1, x)), 'order', concat(s.order, array(k))))[0],
        s -> s.order)"""
    slots = parts.select("period", "all", F.posexplode(F.expr(order)).alias("t", "k")).select("period", F.expr("all[k].key").alias("key"), F.expr("all[k].parts").alias("parts"), "t")
    return slots.groupBy("key", "parts", "period").agg(F.sort_array(F.collect_list("t")).alias("slots"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    power: float = 0.5,
    parts: int = PARTS,
    block_rows: int = BLOCK_ROWS,
    digits: int = DIGITS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All rows with ``mix_block`` (from 0, within the source), ``mix_slot``, ``mix_release``, ``mix_deadline``, ``mix_position``.

    ``weights`` (source, weight > 0) states the targets; without it a source
    of n rows gets a weight in proportion to n ** ``power``.
    """
    results = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")
    columns = [f"`{c}`" for c in docs.columns if c not in results]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if f"`{c}`" in columns and not kind.startswith(("map", "variant"))]
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # the given columns travel in a struct, out of the way of the working columns
    keyed = docs.select(F.struct(*columns).alias("_mix_given"), source_key(F.col(source_col)).alias("_mix_key"), draw.alias("_mix_draw"), F.xxhash64(*hashed).alias("_mix_tie"))
    keyed = keyed.withColumn("_mix_bucket", F.substring("_mix_draw", 1, digits))
    counts = keyed.groupBy("_mix_key", "_mix_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mix_key", "_mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_offset"))
    if weights is None:
        target = whole_parts(counts.groupBy(F.col("_mix_key").alias("key")).agg(weight_of(F.sum("n"), power).alias("weight")), parts)
    else:
        stated = weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("stated"))
        stated = counts.select(F.col("_mix_key").alias("key")).distinct().join(stated, "key", "left").fillna({"stated": 1.0})
        whole, total = stated.agg(F.min(F.col("stated") == F.floor("stated")), F.sum("stated")).first()
        if whole and total <= parts:
            target = stated.select("key", F.greatest(F.lit(1), F.col("stated").cast("long")).alias("weight"))
        else:
            target = whole_parts(stated.select("key", F.greatest(F.lit(1), F.round(F.col("stated") * 1_000_000)).cast("long").alias("weight")), parts)
    plan = schedule(target).withColumnRenamed("key", "_mix_key")

    place = Window.partitionBy("_mix_key", "_mix_bucket").orderBy("_mix_draw", F.col(f"_mix_given.`{id_col}`"), "_mix_tie")
    ranked = keyed.withColumn("_mix_row", F.row_number().over(place)).join(offsets, ["_mix_key", "_mix_bucket"])
    # one row per source; Spark broadcasts the plan only if it is small
    rows = ranked.withColumn("_mix_row", F.col("_mix_row") + F.col("_mix_offset") - 1).join(plan, "_mix_key")
    block = F.expr(f"_mix_row div {block_rows}")
    return rows.withColumn("mix_block", block.cast("long")).select(
        *[F.col(f"_mix_given.{c}") for c in columns],
        "mix_block",
        F.expr("(mix_block div parts) * period + slots[cast(mix_block % parts as int)]").cast("long").alias("mix_slot"),
        F.expr("(mix_block * period) div parts").cast("long").alias("mix_release"),
        F.expr("((mix_block + 1) * period + parts - 1) div parts").cast("long").alias("mix_deadline"),
        F.expr(f"((mix_block div parts) * period + slots[cast(mix_block % parts as int)]) * {block_rows} + _mix_row % {block_rows}").cast("long").alias("mix_position"),
    )


MIX_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM documents),
counts AS (SELECT key, count(*) AS n FROM keyed GROUP BY key),
w AS (SELECT key, greatest(1, floor(pow(n, 0.5) * 1000))::BIGINT AS weight, row_number() OVER (ORDER BY key) - 1 AS k, count(*) OVER () AS size FROM counts),
c AS (SELECT key, k, size, greatest(1, (2 * {PARTS} * weight + sum(weight) OVER ()) // (2 * sum(weight) OVER ()))::BIGINT AS parts FROM w),
p AS (SELECT *, (sum(parts) OVER ())::BIGINT AS period FROM c),
lists AS (SELECT list(parts ORDER BY k) AS parts, any_value(size) AS size, any_value(period) AS period FROM p),
edf(t, given, k) AS (
  SELECT -1::BIGINT, list_transform(parts, lambda x: 0::BIGINT), -1::BIGINT FROM lists
  UNION ALL
  SELECT t, list_transform(given, lambda x, i: CASE WHEN i - 1 = best THEN x + 1 ELSE x END), best FROM (
    SELECT e.t + 1 AS t, e.given AS given,
      (list_min(list_transform(range(1, l.size + 1), lambda i: CASE WHEN l.parts[i] > e.given[i] AND (e.given[i] * l.period) // l.parts[i] <= e.t + 1
        THEN (((e.given[i] + 1) * l.period + l.parts[i] - 1) // l.parts[i]) * l.size + i - 1 END)) % l.size)::BIGINT AS best
    FROM edf e, lists l WHERE e.t + 1 < l.period)),
slots AS (SELECT p.key, p.parts, p.period, e.t, row_number() OVER (PARTITION BY p.key ORDER BY e.t) - 1 AS j
  FROM edf e JOIN p ON p.k = e.k),
b AS (SELECT *, r // {BLOCK_ROWS} AS block FROM keyed)
SELECT b.doc_id, b.source, b.block AS mix_block, ((b.block // s.parts) * s.period + s.t)::BIGINT AS mix_slot,
  ((b.block * s.period) // s.parts)::BIGINT AS mix_release,
  (((b.block + 1) * s.period + s.parts - 1) // s.parts)::BIGINT AS mix_deadline,
  (((b.block // s.parts) * s.period + s.t) * {BLOCK_ROWS} + b.r % {BLOCK_ROWS})::BIGINT AS mix_position
FROM b JOIN slots s ON s.key = b.key AND s.j = b.block % s.parts
"""
