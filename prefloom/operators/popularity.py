"""Counts, shares, tendencies and spans over rating and order events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def over_max(df: DataFrame, column: str, name: str, within: list[str] | None = None, digits: int = 6) -> DataFrame:
    """``column`` over its maximum, of all rows or of those with equal ``within``.

    The maximum is an aggregate joined back, so that no window gathers all rows in one task.
    """
    keys = within or []
    most = df.groupBy(*keys).agg(F.max(column).alias("_most"))
    joined = df.join(most, keys) if keys else df.crossJoin(F.broadcast(most))
    return joined.withColumn(name, F.round(F.try_divide(F.col(column).cast("double"), F.col("_most")), digits)).drop("_most")


def popularity(events: DataFrame, by: str, rating: str | None = "rating") -> DataFrame:
    """How often each value of ``by`` occurs, that over the maximum, and its mean rating."""
    aggregates = [F.count("*").alias("n")] + ([F.round(F.avg(rating), 6).alias("mean_rating")] if rating else [])
    return over_max(events.where(F.col(by).isNotNull()).groupBy(by).agg(*aggregates), "n", "popularity")


def category_share(events: DataFrame) -> DataFrame:
    """For each item: its popularity, its category's, and its share of the most popular in the category."""
    items = events.groupBy("category", "item_id").agg(F.count("*").alias("n"))
    items = over_max(over_max(items, "n", "item_popularity"), "n", "share_in_category", ["category"])
    categories = over_max(events.groupBy("category").agg(F.count("*").alias("category_n")), "category_n", "category_popularity")
    return items.join(categories, "category").select("category", "item_id", "n", "item_popularity", "share_in_category", "category_popularity")


def frequencies(events: DataFrame) -> DataFrame:
    """Counts by item, item and year, item and month, and the same of categories, in one pass of grouping sets."""
    e = events.select("item_id", "category", F.year(F.timestamp_seconds("ts")).alias("y"), F.month(F.timestamp_seconds("ts")).alias("m"))
    sets = [["item_id"], ["item_id", "y"], ["item_id", "y", "m"], ["category"], ["category", "y"], ["category", "y", "m"]]
    out = e.groupingSets([[F.col(c) for c in s] for s in sets], "item_id", "category", "y", "m").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("item_id").isNotNull(), "i").otherwise("c")
    size = F.when(F.col("m").isNotNull(), "pym").when(F.col("y").isNotNull(), "py").otherwise("p")
    return out.select(F.concat(level, size).alias("level"), "item_id", "category", F.col("y").cast("int").alias("y"), F.col("m").cast("int").alias("m"), "n")


def repurchase_tendency(events: DataFrame, by: str) -> DataFrame:
    """orders * ln(users) / users, over its maximum."""
    e = events.groupBy(by).agg(F.count("*").alias("orders"), F.countDistinct("user_id").alias("users"))
    e = e.withColumn("raw", F.col("orders") * F.log(F.col("users").cast("double")) / F.col("users"))
    return over_max(e, "raw", "tendency").select(by, "orders", "users", "tendency")


def life_span(events: DataFrame, by: str = "category") -> DataFrame:
    """Days between a user's first and last purchase in a category, where there are any."""
    e = events.groupBy("user_id", by).agg((F.max("ts") - F.min("ts")).alias("s")).where("s > 0")
    return e.select("user_id", by, F.round(F.col("s") / 86400, 3).alias("days"))


def repurchase_intervals(events: DataFrame, by: str = "category") -> DataFrame:
    """Days between consecutive distinct purchase times of a user in a category."""
    times = events.select("user_id", by, "ts").distinct()
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy("user_id", by).orderBy("ts"))
    return times.withColumn("s", gap).where("s is not null").select("user_id", by, "ts", F.round(F.col("s") / 86400, 3).alias("days"))


def first_purchase_gaps(events: DataFrame, by: str = "category") -> DataFrame:
    """For each two categories of a user, in both orders, the days from the first purchase in one to that in the other."""
    first = events.groupBy("user_id", by).agg(F.min("ts").alias("ts"))
    a, b = first.select("user_id", F.col(by).alias("from_c"), F.col("ts").alias("t1")), first.select("user_id", F.col(by).alias("to_c"), F.col("ts").alias("t2"))
    return a.join(b, "user_id").where("from_c <> to_c").select("user_id", "from_c", "to_c", F.round((F.col("t2") - F.col("t1")) / 86400, 3).alias("days"))


def order_scores(gaps: DataFrame) -> DataFrame:
    """How often a category is bought after each other one, summed over the others."""
    share = gaps.groupBy("from_c", "to_c").agg(F.avg(F.when(F.col("days") >= 0, 1.0).otherwise(0.0)).alias("share"))
    return share.groupBy("to_c").agg(F.round(F.sum("share"), 6).alias("score"))


def segment_counts(events: DataFrame, users: DataFrame, segment: str = "segment") -> DataFrame:
    """Item counts by users' segment, ranked; users without segment are left out."""
    e = events.join(users.where(F.col(segment).isNotNull()), "user_id").groupBy(segment, "item_id").agg(F.count("*").alias("n"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy(segment).orderBy(F.desc("n"), "item_id")))


def min_max(df: DataFrame, column: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Scaled so that the least of 0 and the minimum is 0 and the greatest of 0 and the maximum is 1; null where both are 0."""
    keys = within or []
    span = df.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(column)).alias("_lo"), F.greatest(F.lit(0.0), F.max(column)).alias("_hi"))
    joined = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))
    scaled = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.withColumn(name, F.round(scaled, 6)).drop("_lo", "_hi")


def rmse(predicted: Column, actual: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - actual, F.lit(2.0))))


def merge_attributes(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """(id, attrs map) of many files: of an attribute's values that of the last file counts."""
    each = [f.select(key, F.explode("attrs").alias("k", "v"), F.lit(i).alias("_at")) for i, f in enumerate(frames)]
    rows = each[0]
    for f in each[1:]:
        rows = rows.unionByName(f)
    last = rows.groupBy(key, "k").agg(F.max_by("v", "_at").alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attrs"))


def collected(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sorted list of the values of each key."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
