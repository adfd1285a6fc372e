"""Sources: sorted discovery, Parquet with footers, run documents and telemetry tables."""

from __future__ import annotations

import glob
import hashlib
import os
from dataclasses import asdict, dataclass

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(pattern: str) -> list[str]:
    """Matching files, sorted; none is an error."""
    found = sorted(glob.glob(pattern))
    if not found:
        raise FileNotFoundError(f"no files match {pattern}")
    return found


def parquet(spark: SparkSession, files: list[str]) -> DataFrame:
    """Exactly these files: folder names such as type=x do not become columns."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*files)


def first_row_group(spark: SparkSession, file: str, columns: list[str] | None = None) -> DataFrame:
    """A smoke scan: row group 0 of one file."""
    return spark.createDataFrame(pq.ParquetFile(file).read_row_group(0, columns=columns))


def first_group_rows(file: str) -> int:
    """Rows of row group 0."""
    m = pq.read_metadata(file)
    return m.row_group(0).num_rows if m.num_row_groups else 0


@dataclass(frozen=True)
class Footer:
    path: str
    bytes: int
    mtime_ns: int
    rows: int
    row_groups: int
    schema_sha256: str


def footer(path: str, column: str | None = None) -> Footer:
    """What a file's footer says; the fingerprint is of one column's field, or of the whole schema."""
    f, stat = pq.ParquetFile(path), os.stat(path)
    text = str(f.schema_arrow.field(column) if column else f.schema_arrow)
    return Footer(path, stat.st_size, stat.st_mtime_ns, f.metadata.num_rows, f.metadata.num_row_groups, hashlib.sha256(text.encode()).hexdigest())


def footers(spark: SparkSession, files: list[str], column: str | None = None) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(footer(f, column)).values()) for f in files], "path string, bytes long, mtime_ns long, rows long, row_groups long, schema_sha256 string")


def documents(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents in order of their paths, with the path."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(discover(pattern)).withColumn("path", F.input_file_name())


def without_unit(cell: Column) -> Column:
    """A number followed by a unit such as % or MiB."""
    return F.regexp_replace(F.trim(cell), "[ %A-Za-z]+$", "").cast("double")


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with padded names and cells with units; `name [unit]` becomes name, with numbers."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cols = []
    for c in raw.columns:
        bare = c.strip()
        name = bare.split(" [")[0].replace(".", "_")
        cell = F.col(f"`{c}`")
        cols.append(without_unit(cell).alias(name) if "[" in bare else F.trim(cell).alias(name))
    return raw.select(*cols)
