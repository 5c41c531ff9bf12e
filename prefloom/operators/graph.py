"""Entities and interactions: upserts, first-wins edges, adjacency, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def upsert_entities(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` with new (type, name, desc): ids go on from the greatest; an empty description replaces none.

    New ids follow the order of (type, name); ids are numbered by range partitions.
    """
    from ..sources.sinks import dense_numbers

    fresh = new.groupBy("type", "name").agg(F.max(F.nullif("desc", F.lit(""))).alias("desc"))
    kept = current.join(fresh.withColumnRenamed("desc", "_new"), ["type", "name"], "left").select("entity_id", "type", "name", F.coalesce("_new", "desc").alias("desc"))
    missing = fresh.join(current, ["type", "name"], "left_anti").withColumn("_k", F.struct("type", "name"))
    top = F.broadcast(current.agg(F.coalesce(F.max("entity_id"), F.lit(-1)).alias("_top")))
    added = dense_numbers(missing, "_k", "_n").crossJoin(top).select((F.col("_top") + F.col("_n")).alias("entity_id"), "type", "name", "desc")
    return kept.unionByName(added)


def first_edges(edges: DataFrame, order: list[str], typed: bool = False) -> DataFrame:
    """One edge of each unordered pair (and type, if ``typed``): the first in ``order``. By min_by, with partial aggregation."""
    keys = [F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")] + ([F.col("type")] if typed else [])
    rest = [c for c in edges.columns if not (typed and c == "type")]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e")).select(*(["type"] if typed else []), "e.*").select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end: ent is the end, other the other."""
    back = edges.select(F.col("to_id").alias("ent"), F.col("from_id").alias("other"), "type", "value")
    return edges.select(F.col("from_id").alias("ent"), F.col("to_id").alias("other"), "type", "value").unionByName(back)


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted (other, value) lists by entity and type."""
    return both_ways(edges).groupBy("ent", "type").agg(F.sort_array(F.collect_list(F.struct("other", "value"))).alias("interacts"))


def within(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends among ``entities`` (entity_id)."""
    ids = entities.select("entity_id").distinct()
    return edges.join(ids.withColumnRenamed("entity_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("entity_id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def zero_edges(edges: DataFrame) -> DataFrame:
    """Edges that break the rule that values aren't zero."""
    return edges.where("value = 0 or value is null")


def names(ids: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Names of ids, empty where there is none."""
    e = entities.select(F.col("entity_id").alias(key), "name")
    return ids.join(e, key, "left").withColumn("name", F.coalesce("name", F.lit("")))


def ids(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids of (type, name), -1 where there is none."""
    return wanted.join(entities.select("type", "name", "entity_id"), ["type", "name"], "left").withColumn("entity_id", F.coalesce("entity_id", F.lit(-1)))


def last_link(links: DataFrame, order: str) -> DataFrame:
    """The one user and item that each rating node was last linked to, 0 if none."""
    last = links.groupBy("rating_id").agg(F.max_by("user_id", F.when(F.col("user_id").isNotNull(), F.col(order))).alias("user_id"), F.max_by("item_id", F.when(F.col("item_id").isNotNull(), F.col(order))).alias("item_id"))
    return last.select("rating_id", F.coalesce("user_id", F.lit(0)).alias("user_id"), F.coalesce("item_id", F.lit(0)).alias("item_id"))


def ancestors(tree: DataFrame) -> DataFrame:
    """Path of names from the root to each node of (node, name, parent), however deep.

    A round doubles the levels that a path has, so their number is the logarithm of the depth. A parent that is no node
    ends a path; a cycle is an error.
    """
    from ..sources.checkpoints import cut

    paths = cut(tree.select("node", F.array("name").alias("path"), F.col("parent").alias("next")))
    for _ in range(max(1, paths.count()).bit_length() + 1):
        if paths.where("next is not null").isEmpty():
            return paths.select("node", F.array_join("path", "/").alias("path"))
        up = paths.select(F.col("node").alias("_n"), F.col("path").alias("_path"), F.col("next").alias("_next"))
        joined = paths.join(up, paths["next"] == up["_n"], "left")
        paths = cut(joined.select("node", F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path"), F.col("_next").alias("next")))
    raise ValueError("the tree has a cycle")


def first_name(rows: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """The first name of each key."""
    return rows.groupBy(key).agg(F.min_by(name, F.struct(*order)).alias(name))


def parents(paths: DataFrame) -> DataFrame:
    """Distinct (child, parent) of leaf-first node lists."""
    p = paths.select(F.posexplode("nodes").alias("i", "child"), "nodes")
    return p.select("child", F.get("nodes", F.col("i") + 1).alias("parent")).where("parent is not null").distinct()


def ranked(df: DataFrame, by: list[str], order: list, top: int, name: str = "rank") -> DataFrame:
    """The first ``top`` rows of each group; Spark cuts each partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= top)


def dump(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as lines: ``node type id name`` and ``edge type from to value``, tabs between."""
    node = F.concat_ws("\t", F.lit("node"), F.col("type").cast("string"), F.col("entity_id").cast("string"), F.coalesce("name", F.lit("")))
    edge = F.concat_ws("\t", F.lit("edge"), *[F.col(c).cast("string") for c in ("type", "from_id", "to_id", "value")])
    return entities.select(node.alias("value")).unionByName(edges.select(edge.alias("value")))


def with_metadata(recommended: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Recommended rows with their items' ``columns``, null where the item is unknown."""
    return recommended.join(items.select("item_id", *columns), "item_id", "left")


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column occurs: (kind, value, n), in one pass; arrays count each element."""
    types, empty = dict(rows.dtypes), F.array().cast("array<struct<kind:string,value:string>>")

    def cells(c: str):
        values = F.col(c).cast("array<string>") if types[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value"))), empty)

    each = rows.select(F.explode(F.concat(*[cells(c) for c in columns])).alias("_e")).select("_e.*")
    return each.where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))
