"""Row positions, slices, heads and seeded samples.

A global row number never goes through a single-partition window: rows are
range-partitioned by the stated order, each range is numbered locally, and a
per-partition offset (one row per partition, a size fixed by the partition
count) is added.  Range bounds are sampled anew by every job, so the
partition assignment is materialised once (reliable checkpoint) before the
counts and the local numbers read it.  Heads and samples are top-k plans (``orderBy().limit()``),
which keep k rows per task before the final merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .suites import seeded_key


def row_index(df: DataFrame, order: list[str], name: str = "i", partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order`` (which must be unique)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled per job, so the partition id is computed once and
    # materialised: counts and local numbers then see the same assignment.
    r = cut_lineage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid").orderBy(*order)
    return (
        r.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_local") - 1).cast("long"))
        .drop("_pid", "_local", "_off")
    )


def group_row_index(df: DataFrame, group: list[str], order: list[str], name: str = "i", partitions: int | None = None) -> DataFrame:
    """0-based position of every row inside its group, in the stated (unique) order.

    A hot group (say, a third of all rows) is not numbered in one task: rows
    are range-partitioned by (group, order), each range numbers its slice of
    the group, and the offsets of earlier slices come from a small table of
    per-(group, partition) counts.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", *group).orderBy(*order)
    # null is a group of its own
    on = reduce(lambda a, b: a & b, [r[c].eqNullSafe(offsets[c]) for c in [*group, "_pid"]])
    return (
        r.withColumn("_local", F.row_number().over(local))
        .join(offsets, on)
        .drop(*[offsets[c] for c in [*group, "_pid"]])
        .withColumn(name, (F.col("_off") + F.col("_local") - 1).cast("long"))
        .drop("_pid", "_local", "_off")
    )


def row_slice(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """The rows at positions [start, end) of the stated order."""
    return row_index(df, order, "_i").where((F.col("_i") >= start) & (F.col("_i") < end)).drop("_i")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """the first ``n`` rows by a stated order (top-k plan)."""
    return df.orderBy(*order).limit(n)


def fill_id(df: DataFrame, id_col: str, nested_col: str, order: list[str], out: str = "filled_id") -> DataFrame:
    """Own id, else the nested id, else ``item_<position>`` (position in the stated order)."""
    r = row_index(df, order, "_i")
    return r.withColumn(
        out, F.coalesce(F.col(id_col), F.col(nested_col), F.concat(F.lit("item_"), F.col("_i").cast("string")))
    ).drop("_i")


def batch_assign(df: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """Fixed-size batches of ``size`` rows in the stated order."""
    r = row_index(df, order, "_i")
    return r.withColumn(out, F.floor(F.col("_i") / size).cast("long")).drop("_i")


def shard_ranges(df: DataFrame, order: list[str], shards: int, out: str = "shard") -> DataFrame:
    """E12 (script form): ``shards`` contiguous ranges of ceil(total / shards) rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    r = row_index(df, order, "_i")
    per = F.ceil(total / F.lit(shards))
    return r.withColumn(out, F.floor(F.col("_i") / per).cast("long")).drop("_i")


def stratified_head(df: DataFrame, subset_col: str, subsets: list[str], order: str, n: int, allow_unlisted: bool = False) -> DataFrame:
    """``n`` rows spread over the listed subsets in order; the first ``n % m`` subsets
    get one more; a subset smaller than its quota gives all its rows.

    One top-k plan per subset: each task keeps at most the quota, never a whole subset.
    Subsets that the data has but the list has not raise an error, unless
    ``allow_unlisted`` says that they are left out on purpose.
    """
    m = len(subsets)
    if not allow_unlisted:
        other = df.where(F.col(subset_col).isNull() | ~F.col(subset_col).isin(subsets)).select(subset_col).distinct().limit(5).collect()
        if other:
            raise ValueError(f"subsets not listed: {sorted(str(r[0]) for r in other)}")
    out = None
    for i, name in enumerate(subsets):
        quota = n // m + (1 if i < n % m else 0)
        part = df.where(F.col(subset_col) == name).orderBy(order).limit(quota)
        out = part if out is None else out.unionByName(part)
    return out


def smallest(df: DataFrame, key: Column, n: int, digits: int = 3) -> DataFrame:
    """The ``n`` rows with the smallest hexadecimal ``key`` (a hash: its digits are even), without a global sort.

    One aggregate counts the rows of each of the ``16 ** digits`` key prefixes;
    the cumulated counts give the prefix that holds the n-th row.  Rows before
    it are kept by a plain filter, whatever ``n``; only the rows of that one
    prefix are ranked, and taken to further digits first while they are many.
    """
    keyed = df.withColumn("_key", key)
    prefix, kept, need = "", [], n
    while True:
        width = len(prefix) + digits
        sizes = keyed.where(F.col("_key").startswith(prefix)).groupBy(F.substring("_key", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 16 ** digits rows
        cut, before = None, 0
        for r in sorted(sizes, key=lambda r: r.p):
            if before + r.n > need:
                cut = r
                break
            before += r.n
        inside = F.col("_key").startswith(prefix)
        if cut is None:
            kept.append(keyed.where(inside))
            break
        kept.append(keyed.where(inside & (F.substring("_key", 1, width) < cut.p)))
        prefix, need = cut.p, need - before
        if need == 0 or cut.n <= CUT_ROWS or width >= 32 - digits:
            others = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
            kept.append(keyed.where(F.col("_key").startswith(prefix)).orderBy("_key", F.xxhash64(*others)).limit(need))
            break
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.drop("_key")


#: Rows of one key prefix that are ranked by a top-k plan.
CUT_ROWS = 100_000


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, drawn by the seeded hash of ``key``; any ``n``, no single-task sort."""
    return smallest(df, seeded_key(seed, key), n)
