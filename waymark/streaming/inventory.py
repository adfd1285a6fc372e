"""A provenance inventory kept per file: files that did not change are not read again, and results do not depend on order.

Each file's partial counts and catalog are tables in the checkpoint folder, valid for exactly that file (path, size, time,
rows, row groups, schema) and way of scanning. The final inventory adds the partial tables up, checks that they agree with
each other and with the files' footers, and publishes nothing if they don't. The same partials can be fed by a stream of new
files. Folders are those of a file system that the driver sees too, as single files are listed and published from there.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators import provenance as prov
from waymark.sources import readers, writers

VERSION = 2
FIELDS = ("dataset", "property", "license", "update_time", "confidence")


def partial(lists: DataFrame) -> DataFrame:
    """kind, key, counts: what adds up over files."""
    cards = prov.cardinality(lists).select(F.lit("cardinality").alias("kind"), F.coalesce(F.col("cardinality").cast("string"), F.lit("null")).alias("key"), F.col("features").alias("n"))
    combos = prov.combinations(lists).select(F.lit("combination").alias("kind"), F.col("combination").alias("key"), F.col("features").alias("n"))
    odd = prov.anomalies(lists)
    names = odd.columns
    stacked = odd.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in names])).alias("x")).select(F.lit("anomaly").alias("kind"), "x.key", "x.n")
    items = lists.select(F.explode("sources").alias("item")).groupBy(prov.key_json(F.col("item")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("items").alias("kind"), "key", "n")
    return cards.union(combos).union(stacked).union(items)


def _valid(path: str, marker: dict) -> bool:
    try:
        with open(f"{path}.json", encoding="utf-8") as f:
            return json.load(f) == marker and os.path.isdir(path)
    except (OSError, ValueError):
        return False


def checked_lists(rows: DataFrame) -> DataFrame:
    """The `sources` lists of a file with the item fields that the inventory uses, whatever others there are."""
    kind = rows.schema["sources"].dataType if "sources" in rows.columns else None
    if not isinstance(kind, T.ArrayType):
        raise ValueError("sources must be a list")
    item = kind.elementType
    have = {f.name: f.dataType.simpleString() for f in item.fields} if isinstance(item, T.StructType) else {}
    wrong = [n for n in FIELDS if have.get(n) != ("double" if n == "confidence" else "string")]
    if wrong:
        raise ValueError(f"items of sources lack or mistype {', '.join(wrong)}")
    between = (lambda x: x["between_present"]) if "between_present" in have else (lambda x: x["between"].isNotNull()) if "between" in have else (lambda x: F.lit(False))
    item = lambda x: F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in FIELDS], F.coalesce(between(x), F.lit(False)).alias("between_present")))
    return rows.select(F.transform("sources", item).alias("sources"))


def partials(spark: SparkSession, files: list[str], checkpoints: str, rebuild: bool = False, smoke: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The partial counts and catalogs of all files, and the number of files that were read.

    All files must have the same `sources` column, a list of items; else nothing is written. A smoke run takes the first row
    group of each file, and its partials are apart.
    """
    feet = [readers.footer(f, "sources") for f in files]
    if not feet:
        raise FileNotFoundError("no files")
    if len({x.schema_sha256 for x in feet}) > 1:
        raise ValueError("files differ in the schema of sources")
    checked_lists(spark.read.parquet(files[0]))
    folder = os.path.join(checkpoints, "smoke") if smoke else checkpoints
    os.makedirs(folder, exist_ok=True)
    paths, read = [], 0
    for x in feet:
        marker = {"version": VERSION, "smoke": smoke, "input": asdict(x)}
        path = os.path.join(folder, hashlib.sha256(x.path.encode()).hexdigest()[:24])
        if rebuild or not _valid(path, marker):
            rows = readers.first_row_group(spark, x.path, ["sources"]) if smoke else spark.read.parquet(x.path)
            lists = checked_lists(rows)
            partial(lists).write.mode("overwrite").parquet(f"{path}/counts")
            prov.partial_catalog(lists).write.mode("overwrite").parquet(f"{path}/catalog")
            writers.atomic_json(f"{path}.json", marker)
            read += 1
        paths.append(path)
    return spark.read.parquet(*[f"{p}/counts" for p in paths]), spark.read.parquet(*[f"{p}/catalog" for p in paths]), read


def inventory(spark: SparkSession, files: list[str], checkpoints: str, rebuild: bool = False) -> tuple[DataFrame, int]:
    """The added-up inventory (kind, key, n) and the number of files that were read."""
    counts, _, read = partials(spark, files, checkpoints, rebuild)
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), read


def checks(counts: DataFrame, catalog: DataFrame, files: int, expected_files: int, expected_rows: int) -> dict[str, bool]:
    """Whether all parts of an inventory add up, and to what the files' footers say."""
    per = counts.where("kind in ('cardinality', 'combination', 'items')")
    n = {r.kind: (r.n, r.listed) for r in per.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.coalesce(F.expr("try_cast(key as bigint)"), F.lit(0)) * F.col("n")).alias("listed")).collect()}
    listed = catalog.agg(F.sum("items").alias("items"), F.sum(F.col("first_position") + F.col("later_position")).alias("places")).first()
    features, items = n.get("cardinality", (0, 0))
    return {
        "all_files": files == expected_files,
        "features_as_in_footers": features == expected_rows,
        "combinations_add_up": n.get("combination", (0, 0))[0] == features,
        "items_add_up": n.get("items", (0, 0))[0] == items,
        "catalog_adds_up": (listed["items"] or 0) == items and (listed["places"] or 0) == items,
    }


def publish(spark: SparkSession, files: list[str], checkpoints: str, out: str, rebuild: bool = False, smoke: bool = False) -> dict:
    """Writes catalog.csv, combinations.csv, cardinality.csv and summary.json to out (out/smoke for a smoke run of the first file, which
    is never complete) and returns the summary; a check that fails is an error, and then nothing is written.

    Equal inputs give equal bytes, whether partials were kept or made anew.
    """
    some = files[:1] if smoke else files
    counts, parts, read = partials(spark, some, checkpoints, rebuild, smoke)
    counts = counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    catalog = prov.merged_catalog(parts)
    rows = sum(readers.first_group_rows(f) if smoke else readers.footer(f).rows for f in some)
    found = checks(counts, catalog, len(some), len(some), rows)
    if not all(found.values()):
        raise RuntimeError(f"the inventory does not add up: {', '.join(k for k, good in found.items() if not good)}")
    folder = os.path.join(out, "smoke") if smoke else out
    of = lambda kind: counts.where(F.col("kind") == kind).select("key", "n")
    shown = catalog.withColumn("licenses", prov.text_of(F.array_sort("licenses"))).orderBy(F.col("dataset").asc_nulls_last(), F.col("property").asc_nulls_last())
    writers.csv(shown, os.path.join(folder, "catalog.csv"), {c: 6 for c in ("min_confidence", "max_confidence", "mean_confidence")})
    combos = of("combination").withColumn("combination_id", F.sha2("key", 256)).orderBy(F.col("n").desc(), "key")
    writers.csv(combos, os.path.join(folder, "combinations.csv"))
    writers.csv(of("cardinality").orderBy(F.expr("try_cast(key as bigint)").asc_nulls_last()), os.path.join(folder, "cardinality.csv"))
    summary = {"complete": not smoke, "files": len(some), "features": rows, "items": int(catalog.agg(F.sum("items")).first()[0] or 0), "anomalies": {r.key: r.n for r in of("anomaly").collect()}, "checks": found}
    writers.atomic_json(os.path.join(folder, "summary.json"), summary)
    return summary | {"read": read}


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str):
    """A stream that takes in new files of the folder once each, writes their partials, and stops when all are in."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch.select("sources")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.schema(schema).parquet(folder)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
