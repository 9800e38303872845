"""Helpers that several training-data operators share.

Text reaches the Python workers as UTF-8 bytes in Arrow batches; a task keeps
one batch, and work inside it goes in blocks of bounded bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Text bytes that one task works on at once.
BLOCK_BYTES = 4 << 20


def _word_table() -> bytes:
    """A-Z to a-z; every other ASCII character that is no digit or letter to a space."""
    table = bytearray(range(256))
    for b in range(128):
        ch = chr(b)
        table[b] = ord(ch.lower()) if ch.isalnum() else 0x20
    return bytes(table)


#: ``text.translate(WORD_TABLE).split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_TABLE = _word_table()


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, a-z and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: Iterable[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Half-open row ranges whose sizes add up to about ``limit`` (a single larger row is its own range)."""
    start, total, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, n
            start, total = n, 0
    if start < n:
        yield start, n


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """One Arrow batch in, at most one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows whose text ``keep`` accepts, all columns untouched (whatever their names)."""
    place = df.columns.index(text_col)
    return map_batches(df, lambda b: b.filter(pa.array(keep(text_bytes(b.column(place))))), df.schema)


def stored(df: DataFrame) -> DataFrame:
    """Write to Parquet in the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit_in_task(sample: DataFrame, learn: Callable[[pa.Table], object]):
    """Fit a model on a sample of documented bound in one task; the driver gets the model, or None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(learn(pa.Table.from_batches(got)))], pa.binary())], names=["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return cloudpickle.loads(bytes(rows[0].model)) if rows else None


def bounded_share(counts: float, bound: int) -> float:
    """The share of ``counts`` rows (or bytes) that a sample of about ``bound`` of them takes."""
    return min(1.0, bound / counts) if counts else 1.0


def in_share(id_col: str, share: Column | float, seed: int = 17) -> Column:
    """Whether a row's seeded id hash falls into the share: the same rows in every run."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return draw < share

