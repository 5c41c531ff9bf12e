"""The domain's tables out of the star schema, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: user, item, order, time, quantity, price, category, brand, rating 1 to 5.

    The part table joins without a hint: Spark broadcasts it while its size allows and shuffles beyond.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.unix_timestamp("o_orderdate").alias("ts"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    rating = (F.floor((F.col("quantity") - 1) / 10) + 1).cast("int")
    return li.join(o, "order_id").join(p, "item_id").select("user_id", "item_id", "order_id", "ts", "quantity", "price", "category", "brand", rating.alias("rating"))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and item of each order line, of items that the part table lacks too."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id")).join(o, "order_id").select("user_id", "item_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("age"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


#: Views that the queries' SQL begins with.
EVENTS_SQL = """ev AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderkey AS order_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
  l_quantity AS quantity, l_extendedprice AS price, p_type AS category, p_brand AS brand, CAST(floor((l_quantity - 1) / 10) AS INTEGER) + 1 AS rating
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""
USERS_SQL = "us AS (SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, CAST(floor(c_acctbal / 1000) AS INTEGER) AS age FROM customer)"
ITEMS_SQL = "it AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS price, p_size AS size FROM part)"
