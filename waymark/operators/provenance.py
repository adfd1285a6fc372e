"""Inventory of nested provenance lists: catalog, combinations, cardinality and anomalies, in built-in functions only.

features: feature_id, sources array<struct<dataset, property, license, update_time, confidence, between_present>>, where a
null list, an empty list and a list with a null item are three different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<dataset:string,property:string,license:string,update_time:string,confidence:double,between_present:boolean>"


def nested(features: DataFrame, items: DataFrame) -> DataFrame:
    """Features with their lists, from one row per item."""
    value = F.when(~F.col("item_is_null"), F.struct("dataset", "property", "license", "update_time", F.col("confidence").cast("double").alias("confidence"), "between_present"))
    lists = items.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("item")))).alias("l")).select("feature_id", F.transform("l", lambda x: x["item"]).alias("got"))
    joined = features.join(lists, "feature_id", "left")
    empty = F.array().cast(f"array<{ITEM}>")
    return joined.select("feature_id", F.when(F.col("list_state") == "valid", F.col("got")).when(F.col("list_state") == "empty", empty).alias("sources"))


def exploded(lists: DataFrame) -> DataFrame:
    return lists.select("feature_id", F.posexplode("sources").alias("pos", "item")).select("feature_id", "pos", F.col("item").isNull().alias("null_item"), "item.*")


def totals(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count("*").alias("features"), F.coalesce(F.sum(F.when(F.col("sources").isNotNull(), F.size("sources"))), F.lit(0)).cast("long").alias("items"))


def cardinality(lists: DataFrame) -> DataFrame:
    """Features by list length; a null length for null lists."""
    n = F.when(F.col("sources").isNotNull(), F.size("sources").cast("long"))
    out = lists.groupBy(n.alias("cardinality")).agg(F.count("*").alias("features"))
    return out.withColumn("status", F.when(F.col("cardinality").isNull(), "null").otherwise("valid"))


def anomalies(lists: DataFrame) -> DataFrame:
    """One row of counts: null lists, empty lists, null items, items without dataset, without property (null items are both)."""
    count = lambda test: F.coalesce(F.sum(F.size(F.filter("sources", test))), F.lit(0)).cast("long")
    known = lists.select(F.col("sources").isNull().alias("was_null"), F.coalesce("sources", F.array().cast(f"array<{ITEM}>")).alias("sources"))
    return known.agg(
        F.sum(F.col("was_null").cast("long")).alias("null_lists"),
        F.sum((~F.col("was_null") & (F.size("sources") == 0)).cast("long")).alias("empty_lists"),
        count(lambda x: x.isNull()).alias("null_items"),
        count(lambda x: x["dataset"].isNull()).alias("missing_dataset"),
        count(lambda x: x["property"].isNull()).alias("missing_property"),
    )


def scope() -> Column:
    return F.when(F.col("property").isNull(), "missing").when(F.col("property") == "", "whole_feature").otherwise("field")


def partial_catalog(lists: DataFrame) -> DataFrame:
    """Per (dataset, property), nulls included: what adds up over parts of the features.

    licenses is the set of JSON texts of licences, 'null' for none. A key counts a feature once however often its list has it; that is
    seen within the list, so nothing is shuffled but the sums.
    """
    at = F.posexplode("sources").alias("pos", "item")
    same = lambda x, y: x["dataset"].eqNullSafe(y["dataset"]) & x["property"].eqNullSafe(y["property"])
    rows = lists.select("sources", at)
    rows = rows.withColumn("first_of_feature", ~F.exists(F.slice("sources", F.lit(1), F.col("pos")), lambda x: same(x, F.col("item"))))
    items = rows.select("pos", "first_of_feature", F.col("item.*"))
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    return items.groupBy("dataset", "property").agg(
        F.count("*").alias("items"),
        count(F.col("first_of_feature")).alias("features"),
        count(F.col("pos") == 0).alias("first_position"),
        count(F.col("pos") > 0).alias("later_position"),
        count(F.col("license").isNotNull()).alias("with_license"),
        F.collect_set(F.coalesce(F.concat(F.lit('"'), "license", F.lit('"')), F.lit("null"))).alias("licenses"),
        F.min("update_time").alias("min_update_time"),
        F.max("update_time").alias("max_update_time"),
        count(F.col("confidence").isNotNull()).alias("with_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.sum("confidence").alias("sum_confidence"),
        count(F.col("between_present")).alias("with_between"),
    )


ADDED = ("items", "features", "first_position", "later_position", "with_license", "with_confidence", "with_between")


def merged_catalog(partials: DataFrame) -> DataFrame:
    """The catalog from partial ones of disjoint features, in any order: dataset, property, sums, licenses, extremes, mean, scope."""
    extremes = [f(c).alias(c) for f, c in ((F.min, "min_update_time"), (F.max, "max_update_time"), (F.min, "min_confidence"), (F.max, "max_confidence"))]
    sums = [F.sum(c).alias(c) for c in ADDED]
    out = partials.groupBy("dataset", "property").agg(*sums, *extremes, F.sum("sum_confidence").alias("s"), F.array_distinct(F.flatten(F.collect_list("licenses"))).alias("licenses"))
    mean = F.when(F.col("with_confidence") > 0, F.col("s") / F.col("with_confidence"))
    return out.withColumn("mean_confidence", mean).withColumn("scope", scope()).drop("s")


def text_of(cells: Column) -> Column:
    """JSON texts as one list."""
    return F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))


def catalog(lists: DataFrame) -> DataFrame:
    """Per (dataset, property), nulls included: counts, presence, extremes, mean confidence, distinct features, positions."""
    return merged_catalog(partial_catalog(lists)).drop("licenses")


def licenses(lists: DataFrame) -> DataFrame:
    """Distinct licenses per (dataset, property) as JSON, null first."""
    d = exploded(lists).select("dataset", "property", "license").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.col("license").isNotNull().alias("k"), "license")))
    return d.groupBy("dataset", "property").agg(F.to_json(F.transform(ordered, lambda x: x["license"]), {"ignoreNullFields": "false"}).alias("licenses"))


def key_json(item: Column) -> Column:
    return F.to_json(F.array(item["dataset"], item["property"]))


def combination(sources: Column) -> Column:
    """The list's multiset of keys as JSON, in order of their texts; 'null' for a null list."""
    return F.when(sources.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(sources, key_json)), ","), F.lit("]")))


def combinations(lists: DataFrame) -> DataFrame:
    out = lists.groupBy(combination(F.col("sources")).alias("combination")).agg(F.count("*").alias("features"))
    status = F.when(F.col("combination") == "null", "null").when(F.col("combination") == "[]", "empty").otherwise("valid")
    return out.withColumn("combination_id", F.sha2("combination", 256)).withColumn("status", status)


def reconciled(lists: DataFrame) -> DataFrame:
    """Checks that all parts of the inventory add up: name, passed."""
    t = totals(lists)
    sums = (
        t.crossJoin(cardinality(lists).agg(F.sum("features").alias("card_features"), F.sum(F.coalesce("cardinality", F.lit(0)) * F.col("features")).alias("card_items")))
        .crossJoin(combinations(lists).agg(F.sum("features").alias("comb_features")))
        .crossJoin(catalog(lists).agg(F.sum("items").alias("cat_items"), F.sum(F.col("first_position") + F.col("later_position")).alias("cat_positions"), F.sum("first_position").alias("firsts")))
        .crossJoin(anomalies(lists))
    )
    checks = {
        "cardinality_features": F.col("card_features") == F.col("features"),
        "cardinality_items": F.col("card_items") == F.col("items"),
        "combination_features": F.col("comb_features") == F.col("features"),
        "catalog_items": F.col("cat_items") == F.col("items"),
        "catalog_positions": F.col("cat_positions") == F.col("items"),
        "first_positions": F.col("firsts") == F.col("features") - F.col("null_lists") - F.col("empty_lists"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("passed")) for k, v in checks.items()])
    return sums.select(F.explode(rows).alias("c")).select("c.*")
