"""Artefacts of a run: tables, small reports, checksums, manifests, and the contract between tables that belong together."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
import re
import subprocess
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and any executor can be lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def checksum(spark: SparkSession, path: str, block: int = 1 << 20) -> str:
    """SHA-256 of one file, read in blocks."""
    at, system = _open(spark, path)
    digest, stream = hashlib.sha256(), system.open(at)
    try:
        while part := bytes(stream.readNBytes(block)):
            digest.update(part)
    finally:
        stream.close()
    return digest.hexdigest()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, everything below it included."""
    at, system = _open(spark, path)
    return int(system.getContentSummary(at).getLength())


def readable(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> dict[str, int]:
    """Writes Parquet and says how many rows and bytes it has; the rows are counted from the files' footers."""
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by, compression="snappy")
    spark = df.sparkSession
    return {"rows": spark.read.schema(df.schema).parquet(path).count(), "bytes": size_of(spark, path)}


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header, in the folder `path`."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def markdown(df: DataFrame, most: int = 40) -> str:
    """The first rows as a Markdown table; missing values are empty, and a note says that rows were left out."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "" if x is None or x != x else f"{x:g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", f"|{'-|' * len(df.columns)}", *(f"| {' | '.join(cell(x) for x in r)} |" for r in rows[:most])]
    return "\n".join([*lines, *([f"\nOnly the first {most} rows are shown."] if len(rows) > most else [])]) + "\n"


def commit_of(folder: str) -> str | None:
    """The commit a folder's working tree stands at; None where it is none, or git is missing."""
    try:
        found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return found.stdout.strip() or None if found.returncode == 0 else None


def manifest(spark: SparkSession, config: Mapping, inputs: Mapping[str, str], tables: Mapping[str, Mapping[str, int]], seconds: Mapping[str, float], warnings: list[str]) -> str:
    """A run's JSON: configuration, checksums of the input files, versions, the code's commit, sizes of its tables, timings and warnings."""
    versions = {p: importlib.metadata.version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}
    found = {name: {"path": path, "sha256": checksum(spark, path), "bytes": size_of(spark, path)} for name, path in inputs.items()}
    out = {"config": dict(config), "inputs": found, "python": platform.python_version(), "platform": platform.platform(), "versions": versions, "commit": commit_of(str(Path(__file__).resolve().parent)), "tables": {k: dict(v) for k, v in tables.items()}, "seconds": dict(seconds), "warnings": list(warnings)}
    return json.dumps(out, indent=2, sort_keys=True, default=str)


def same_keys(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per table: its rows, distinct keys, and keys of the first table that it lacks or has beyond them (all must be 0 and equal).
    Tables are joined by key, so that the order of their rows doesn't matter."""
    (_, first), out = next(iter(tables.items())), None
    for name, df in tables.items():
        marked = first.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(df.select(key, F.lit(0), F.lit(1)))
        per_key = marked.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        one = per_key.agg(F.lit(name).alias("table"), F.sum("b").alias("rows"), F.count_if(F.col("b") > 0).alias("keys"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("lacking"), F.count_if(F.col("a") == 0).alias("beyond"))
        out = one if out is None else out.unionAll(one)
    return out


def nearest_rows(df: DataFrame, t: str, at: int, n: int = 1) -> DataFrame:
    """The row at a time, or the nearest ones, earlier first among equals."""
    return df.orderBy(F.abs(F.col(t) - at), t).limit(n)


def search(dictionary: DataFrame, text: str, columns: list[str], **equal: str) -> DataFrame:
    """Rows of a dictionary that hold the text in any of the columns, whatever its case, and equal the given values."""
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(c), F.lit(text.lower()))
    for c, value in equal.items():
        test = test & (F.col(c) == value)
    return dictionary.where(test)
