"""python -m waymark.cli: list | run NAME DIR | explain NAME DIR | inventory GLOB CHECKPOINTS OUT [--rebuild] [--smoke]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from waymark.plans.catalog import QUERIES
from waymark.sources import readers
from waymark.streaming.inventory import publish


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("name", choices=sorted(QUERIES))
        p.add_argument("dir")
        p.add_argument("--rows", type=int, default=20)
    p = sub.add_parser("inventory")
    p.add_argument("glob")
    p.add_argument("checkpoints")
    p.add_argument("out")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--smoke", action="store_true")
    a = top.parse_args(args)
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    if a.what == "inventory":
        print(json.dumps(publish(spark, readers.discover(a.glob), a.checkpoints, a.out, a.rebuild, a.smoke), sort_keys=True))
    elif a.what == "run":
        QUERIES[a.name](spark, a.dir).show(a.rows, truncate=False)
    else:
        QUERIES[a.name](spark, a.dir).explain("formatted")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
