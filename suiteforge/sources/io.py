"""Readers and writers.

All paths go through Spark's data sources, so the same code reads local
files, HDFS or object stores.  Existence checks use the Hadoop FileSystem of
the path (cheap metadata calls on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def path_exists(spark: SparkSession, path: str, nonempty: bool = False) -> bool:
    """True when ``path`` exists (and, with ``nonempty``, holds at least one byte)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return False
    if not nonempty:
        return True
    return fs.getContentSummary(p).getLength() > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A1: JSON-lines source; a missing path raises ``FileNotFoundError``."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A2: a whole-file JSON array of records."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist")
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A3: dispatch on the suffix -- ``.jsonl`` lines, ``.json`` array, ``.parquet``; else ``ValueError``."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json_array(spark, path, schema)
    if path.endswith(".parquet"):
        r = spark.read if schema is None else spark.read.schema(schema)
        return r.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def infer_schema(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> StructType:
    """A4: infer a JSON schema once; pin it for every later read of the same data."""
    return spark.read.option("samplingRatio", sampling_ratio).json(path).schema


def union_sources(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """A5/G1: one read per named subset, tagged with ``source``, UNION ALL by name."""
    out = None
    for name, path in paths.items():
        df = read_records(spark, path, schema).withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def should_skip(spark: SparkSession, path: str, overwrite: bool, nonempty: bool = True) -> bool:
    """Skip a stage whose output exists (optionally: exists and is non-empty) unless ``overwrite``."""
    return (not overwrite) and path_exists(spark, path, nonempty=nonempty)


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Overwrite (default) or append records as JSON lines or parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def append_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Checkpoint-style append (each call adds files; readers see the union)."""
    write_records(df, path, fmt=fmt, mode="append")


def write_round(df: DataFrame, base: str, round_no: int, fmt: str = "parquet") -> None:
    """A10: round-partitioned layout ``base/round=N``; only that round's partition is replaced."""
    rows = df.withColumn("round", F.lit(round_no)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("round").format(fmt).save(base)


def read_round(spark: SparkSession, base: str, round_no: int, fmt: str = "parquet") -> DataFrame:
    """A10: a round's input is the previous round's output (partition pruned by ``round``)."""
    if round_no <= 1:
        raise ValueError("round 1 reads the seed input, not a round partition")
    df = spark.read.parquet(base) if fmt == "parquet" else spark.read.json(base)
    return df.where(F.col("round") == round_no - 1).drop("round")


def write_report(metrics: DataFrame, path: str) -> None:
    """The report table as one text file of ``metric<TAB>key<TAB>value`` lines.

    The metrics table has one row per reported number (bounded by the report,
    not by the data), so a single output file is safe.
    """
    line = F.concat_ws("\t", F.col("metric"), F.coalesce(F.col("key"), F.lit("")), F.col("value").cast("string"))
    metrics.orderBy("metric", "key").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """One row by id (a pushed-down filter on the scan)."""
    return df.where(F.col(key) == value)
