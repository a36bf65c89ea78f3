"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, as Spark's regular expressions write them.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder does for a local master
    only; on a cluster each executor would write to its own disk, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster, intermediate tables need a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and any executor can be lost."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def apart(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with neutral names for all columns but those used, so that no name of an operator's own can clash with one, and the way
    back to the names and order of docs (with further columns, if named)."""
    named = {c: c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in named.items()))
    return inner, lambda df, *more: df.select(*(F.col(n).alias(c) for c, n in named.items()), *more)


def byte_column(batch: pa.RecordBatch, name: str) -> list:
    """The column's strings as UTF-8 bytes, None for null."""
    column = batch.column(name)
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, to_arrow: pa.Schema) -> DataFrame:
    """mapInArrow for a function from record batches to dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=to_arrow)

    return df.mapInArrow(run, schema)


def crc_bucket(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value
