"""Sinks: GeoParquet, CSV, atomic text and JSON, staged folders that are never overwritten."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geo_metadata(kinds: list[str], bounds: tuple[float, float, float, float], column: str = "geometry") -> bytes:
    """The `geo` footer entry of a GeoParquet 1.1 file with a covering bbox column."""
    covering = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": kinds, "bbox": list(bounds), "covering": covering}}}, sort_keys=True).encode()


def geoparquet_file(df: DataFrame, path: str, kinds: list[str], row_group_size: int = 100_000, level: int = 6) -> int:
    """One GeoParquet file, zstd, with bounded row groups; df has geometry and bbox. Returns the number of rows.

    Rows come to the driver one partition at a time: a single file is written by one process.
    """
    b = df.agg(F.min("bbox.xmin"), F.min("bbox.ymin"), F.max("bbox.xmax"), F.max("bbox.ymax")).first()
    schema, writer, n = None, None, 0
    target = f"{path}.part"
    for rows in _chunks(df.toLocalIterator(), row_group_size):
        table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], schema=schema)
        if writer is None:
            schema = table.schema.with_metadata({b"geo": geo_metadata(kinds, tuple(b))})
            writer = pq.ParquetWriter(target, schema, compression="zstd", compression_level=level)
        writer.write_table(table.cast(schema), row_group_size=row_group_size)
        n += len(rows)
    if writer is None:
        raise ValueError("no rows to write")
    writer.close()
    os.replace(target, path)
    return n


def _chunks(rows, size: int) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def parquet_folder(df: DataFrame, path: str) -> None:
    """A folder of zstd Parquet files, written in parallel over what was there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """A small result as one CSV with a header and LF line ends; doubles with the decimals asked for."""
    shown = df.withColumns({c: F.format_string(f"%.{k}f", c) for c, k in (decimals or {}).items()})
    lines = [",".join(_cell(c) for c in shown.columns)] + [",".join(_cell(v) for v in r) for r in shown.collect()]
    atomic_text(path, "\n".join(lines) + "\n")


def _cell(v) -> str:
    text = "" if v is None else str(v)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def atomic_text(path: str, text: str) -> None:
    """The whole text or none of it: written beside the target and renamed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=Path(path).parent, prefix=".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def atomic_json(path: str, value) -> None:
    atomic_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


@contextmanager
def published(folder: str):
    """A staging folder that becomes `folder` if the block succeeds; an existing folder is an error, a failure leaves nothing."""
    if os.path.exists(folder):
        raise FileExistsError(folder)
    Path(folder).parent.mkdir(parents=True, exist_ok=True)
    staging = tempfile.mkdtemp(dir=Path(folder).parent, prefix=".staging-")
    try:
        yield staging
        os.rename(staging, folder)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(df: DataFrame, path: str, inputs: list[str], validation: dict) -> dict:
    """A dataset's lineage: its files and inputs with hashes, bounds and what was validated; all from one aggregate."""
    b = df.agg(F.count("*").alias("rows"), F.min("bbox.xmin").alias("xmin"), F.min("bbox.ymin").alias("ymin"), F.max("bbox.xmax").alias("xmax"), F.max("bbox.ymax").alias("ymax")).first().asDict()
    files = [path] if os.path.isfile(path) else sorted(str(p) for p in Path(path).rglob("*.parquet"))
    rows = b.pop("rows")
    return {"rows": rows, "bounds": b, "files": {f: file_sha256(f) for f in files}, "inputs": {f: file_sha256(f) for f in inputs}, "validation": validation}
