"""Sparse features: handlers, dictionaries, interactions, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import composite_key, falsy, hash_number, normalize_text
from ..sources.checkpoints import cut
from .pairs import all_pairs


def extend_dictionary(current: DataFrame, names: DataFrame) -> DataFrame:
    """``current`` (name, fid) with the names it lacks, numbered on from its greatest id in the order of names; the first id is 1."""
    from ..sources.sinks import dense_numbers

    new = names.select("name").where("name is not null").distinct().join(current, "name", "left_anti")
    top = F.broadcast(current.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("_top")))
    added = dense_numbers(new, "name", "_n").crossJoin(top).select("name", (F.col("_top") + F.col("_n")).alias("fid"))
    return current.select("name", "fid").unionByName(added)


def categorical(kind: str, attribute: str, value: Column) -> Column:
    """One feature ``kind_attribute_value`` with value 1."""
    return F.struct(F.concat(F.lit(f"{kind}_{attribute}_"), normalize_text(value)).alias("name"), F.lit(1.0).alias("value"))


def numeric(kind: str, attribute: str, value: Column) -> Column:
    return F.struct(F.lit(f"{kind}_{attribute}").alias("name"), value.try_cast("double").alias("value"))


def missing(kind: str, attribute: str) -> Column:
    return F.struct(F.lit(f"{kind}_{attribute}#miss").alias("name"), F.lit(1.0).alias("value"))


#: Handlers by name of an attribute's group.
HANDLERS = {"categorical": categorical, "numeric": numeric}


def entity_features(entities: DataFrame, key: str, kind: str, handlers: dict[str, str], required: list[str]) -> DataFrame:
    """(key, name, value): each attribute through its handler; a required one that is missing gives ``#miss``.

    Null, empty and zero are missing.
    """
    cells = []
    for attribute, handler in handlers.items():
        c = F.col(attribute) if attribute in entities.columns else F.lit(None).cast("string")
        absent = missing(kind, attribute) if attribute in required else F.lit(None)
        cells.append(F.when(falsy(c), absent).otherwise(HANDLERS[handler](kind, attribute, c)))
    return entities.select(key, F.explode(F.array_compact(F.array(*cells))).alias("f")).select(key, "f.name", "f.value").where("value is not null")


def indexed(features: DataFrame, dictionary: DataFrame, known_only: bool = True) -> DataFrame:
    """Features with their ids; unknown ones leave, or get a null id."""
    return features.join(dictionary, "name", "inner" if known_only else "left")


def interactions(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """For each (user_id, item_id) pair all products of a user's and an item's features, named ``uid|iid``."""
    u = left.select("user_id", F.col("fid").alias("u"), F.col("value").alias("uv"))
    i = right.select("item_id", F.col("fid").alias("i"), F.col("value").alias("iv"))
    return pairs.join(u, "user_id").join(i, "item_id").select(*pairs.columns, F.concat_ws("|", "u", "i").alias("name"), (F.col("uv") * F.col("iv")).alias("value"))


def _named(features: str, pattern: str) -> Column:
    return F.filter(features, lambda f: f["name"].rlike(pattern))


def _times(factors: Column):
    """From a product to its products with each factor."""
    return lambda x: F.transform(factors, lambda f: F.struct(F.concat_ws("_", x["name"], f["fid"].cast("string")).alias("name"), (x["value"] * f["value"]).alias("value")))


def rule_interactions(rows: DataFrame, patterns: dict[str, str], rule: list[str]) -> DataFrame:
    """``rows`` (id, features array of (name, fid, value)) with int: products over one feature of each pattern in ``rule``.

    A rule with an unregistered pattern is an error; a row that lacks a feature of some pattern gets none.
    """
    unknown = [r for r in rule if r not in patterns]
    if unknown:
        raise ValueError(f"patterns aren't registered: {unknown}")
    out = F.array(F.struct(F.lit("int").alias("name"), F.lit(1.0).alias("value")))
    for r in rule:
        out = F.flatten(F.transform(out, _times(_named("features", patterns[r]))))
    return rows.withColumn("int", out)


def matching(dictionary: DataFrame, pattern: str) -> DataFrame:
    """Features whose name a pattern finds."""
    return dictionary.where(F.col("name").rlike(pattern))


def classified(features: DataFrame, dictionary: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(id, pattern, fid, value): a feature is in every bucket whose pattern its name has."""
    buckets = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(n)) for n, p in sorted(patterns.items())]))
    return features.join(dictionary, "fid").withColumn("pattern", F.explode(buckets)).drop("name")


def repeated_features(features: DataFrame, key: str) -> DataFrame:
    """Features that an entity has more than once."""
    return features.groupBy(key, "fid").agg(F.count("*").alias("n")).where("n > 1")


def category_labels(categories: DataFrame) -> DataFrame:
    """Categories as consecutive class labels from 1, in the order of names."""
    from ..sources.sinks import dense_numbers

    return dense_numbers(categories.select("category").distinct(), "category", "label")


def labelled_pairs(ratings: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Each rating as a positive and ``n`` other items drawn by hash as negatives (they may be bought elsewhere)."""
    total = F.broadcast(items.agg(F.count("*").alias("_items")))
    key = composite_key(F.col("user_id"), F.col("item_id").cast("string"))
    draws = ratings.select("user_id", "item_id").crossJoin(total).select("user_id", F.col("item_id").alias("for_item"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"), "_items", key.alias("k"))
    picked = draws.withColumn("item_no", F.pmod(hash_number(F.concat_ws("_", "k", "draw")), F.col("_items"))).join(items.select("item_no", "item_id"), "item_no").where("item_id <> for_item")
    positive = ratings.select("user_id", "item_id", F.col("item_id").alias("for_item"), F.lit(1).alias("label"))
    return positive.unionByName(picked.select("user_id", "item_id", "for_item", F.lit(0).alias("label")))


def interaction_names(features: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``features`` whose name is ``u|i`` with both features' names, empty where a dictionary lacks one."""
    u = left.select(F.col("fid").cast("string").alias("_u"), F.col("name").alias("left_name"))
    i = right.select(F.col("fid").cast("string").alias("_i"), F.col("name").alias("right_name"))
    parts = F.split("name", r"\|")
    out = features.withColumn("_u", parts[0]).withColumn("_i", F.get(parts, F.lit(1))).join(u, "_u", "left").join(i, "_i", "left")
    return out.drop("_u", "_i").na.fill("", ["left_name", "right_name"])


def prediction_rows(queries: DataFrame, items: DataFrame, item_features: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each query user beside every item with the item's features that a dictionary knows, as an array sorted by id, or ``form`` of it.

    Items' features are gathered and formed once, before they meet the users.
    """
    lists = item_features.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("fid", "value"))).alias("features"))
    empty = F.array().cast("array<struct<fid:bigint,value:double>>")
    features = F.coalesce("features", empty)
    rows = cut(items.select("item_id").join(lists, "item_id", "left").select("item_id", (form(features) if form else features).alias("features")))
    return all_pairs(queries.select("user_id"), rows)


def list_profile(recommended: DataFrame, item_features: DataFrame) -> DataFrame:
    """How often each feature occurs among recommended items."""
    return recommended.join(item_features, "item_id").groupBy("name").agg(F.count("*").alias("n"))
