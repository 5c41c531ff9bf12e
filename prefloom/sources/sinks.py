"""File sinks: libsvm, coordinates, sparse rows, dictionaries, recommendations, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .checkpoints import cut


def libsvm_lines(samples: DataFrame, features: str = "features", weight: str | None = None) -> DataFrame:
    """``[weight] label fid:val ...`` with ascending ids; features is an array of (fid, fval)."""
    pairs = F.array_join(F.transform(F.sort_array(features), lambda x: F.concat_ws(":", x["fid"].cast("string"), x["fval"].cast("string"))), " ")
    head = [F.col(c).cast("string") for c in ([weight] if weight else []) + ["label"]]
    return samples.select(F.concat_ws(" ", *head, pairs).alias("value"))


def coordinates(samples: DataFrame, key: str) -> DataFrame:
    """(row, col, val) of samples with features, rows renumbered from 1 by ``key``."""
    some = samples.where(F.size("features") > 0)
    rows = dense_numbers(some, key, "row")
    return rows.select("row", F.explode("features").alias("x")).select("row", F.col("x.fid").alias("col"), F.col("x.fval").alias("val"))


def coordinate_labels(samples: DataFrame, key: str) -> DataFrame:
    """(row, label) beside ``coordinates``: the same rows by the same numbers."""
    return dense_numbers(samples.where(F.size("features") > 0).select(key, "label"), key, "row").select("row", "label")


def dense_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of ``key`` without gathering all rows in one task.

    Rows are sorted by range and kept, as bounds of ranges are sampled anew whenever a plan runs; a
    count a partition then tells where its numbers begin.
    """
    placed = cut(df.orderBy(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    begin = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_least"))
    begin = begin.withColumn("_begin", F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows"))
    numbered = placed.join(F.broadcast(begin), "_part").withColumn("_number", F.col("_begin") + F.col("_at") - F.col("_least") + 1)
    return numbered.drop("_part", "_at", "_rows", "_least", "_begin").withColumnRenamed("_number", name)


def sparse_lines(features: DataFrame) -> DataFrame:
    """(entity, fid, fval) as lines ``entity,fid:val,...``."""
    pairs = F.sort_array(F.collect_list(F.struct("fid", "fval")))
    rows = features.groupBy("entity").agg(pairs.alias("p"))
    return rows.select(F.concat_ws(",", "entity", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["fid"].cast("string"), x["fval"].cast("string"))), ",")).alias("value"))


def write_groups(features: DataFrame, path: str, group: str = "group") -> None:
    features.write.partitionBy(group).mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("quote", "").mode("overwrite").csv(path)


def write_splits(ratings: DataFrame, path: str, columns: tuple[str, ...] = ("user_id", "item_id")) -> None:
    """Tab-separated files, a folder for each split, as external recommenders take them."""
    ratings.select("split", *columns).write.partitionBy("split").option("sep", "\t").mode("overwrite").csv(path)


def recommendation_json(ranked: DataFrame, names: bool = True) -> DataFrame:
    """(user_id, rank, item_id, item_name, features, feature_names) as one JSON line a user; without ``names`` the ids alone."""
    if not names:
        one = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("r"), F.first("features").alias("features"))
        return one.select("user_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("userId"), "features", F.transform("r", lambda x: x["item_id"].cast("string")).alias("recIdList"))).alias("value"))
    one = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "item_name"))).alias("r"), F.first("features").alias("features"), F.first("feature_names").alias("names"))
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("userId"), "features", F.col("names").alias("featureNames"), F.transform("r", lambda x: x["item_id"].cast("string")).alias("recIdList"), F.transform("r", lambda x: F.coalesce(x["item_name"], F.lit(""))).alias("recNameList")))
    return one.select("user_id", line.alias("value"))


def stored_list(ranked: DataFrame) -> DataFrame:
    """(user_id, rank, item_id, score) as {"i": [{"i": id, "s": score}]} a user."""
    one = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("i"), F.col("score").cast("float").alias("s")))).alias("r"))
    return one.select("user_id", F.to_json(F.struct(F.transform("r", lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))).alias("i"))).alias("value"))


def trec(doc_id: Column, text: Column) -> Column:
    return F.concat(F.lit("<DOC>\n<DOCNO>"), doc_id.cast("string"), F.lit("</DOCNO>\n<TEXT>\n"), F.coalesce(text, F.lit("")), F.lit("\n</TEXT>\n</DOC>"))


def banner(names: Column, top: int) -> Column:
    """The first names of an array as an HTML list."""
    items = F.transform(F.slice(names, 1, top), lambda n: F.concat(F.lit("<li>"), n, F.lit("</li>")))
    return F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>"))
