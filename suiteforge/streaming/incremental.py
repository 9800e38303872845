"""Incremental outcome ingest with Structured Streaming.

New outcome files land in a directory; a stream with ``availableNow`` picks
up whatever is new since its checkpoint, and ``foreachBatch`` appends only
keys the table does not hold yet (anti join).  Replaying a batch after a
failure appends nothing twice, so the table equals a batch de-dup of all
files.  Per-test and per-solution counts are re-aggregated from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.outcomes import P, S, T, solution_pass_rate, test_pass_mean
from ..sources.io import path_exists

KEYS = [P, S, T]


def ingest_outcomes(
    spark: SparkSession,
    source_dir: str,
    table_dir: str,
    checkpoint: str,
    schema,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Run one ``availableNow`` pass of the ingest stream and return the table."""

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if path_exists(spark, table_dir):
            have = spark.read.parquet(table_dir).select(*keys)
            fresh = fresh.join(have, keys, "left_anti")
        fresh.write.mode("append").parquet(table_dir)

    q = (
        spark.readStream.schema(schema)
        .parquet(source_dir)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(table_dir)


def outcome_counts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Up-to-date (per-test, per-solution) counts of the ingested table."""
    return test_pass_mean(table), solution_pass_rate(table)


__all__ = ["ingest_outcomes", "outcome_counts"]
