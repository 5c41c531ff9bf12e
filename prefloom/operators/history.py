"""Ordered purchase histories: what came before, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

DAY = 86400
#: Window sizes of the soft vote in seconds: fixed values.
SCALES = {"day": DAY, "week": 7 * DAY, "bi_week": 14 * DAY, "month": 30 * DAY, "bi_month": 60 * DAY, "season": 90 * DAY, "half_year": 180 * DAY, "year": 360 * DAY, "bi_year": 720 * DAY}
REACH = 3


def moments(events: DataFrame, by: str = "category") -> DataFrame:
    """How many lines a user has of a category at a time: lines of one time are no history to each other."""
    return events.groupBy("user_id", "ts", by).agg(F.count("*").alias("n"))


def past_pairs(events: DataFrame, by: str = "category") -> DataFrame:
    """Each (user, time, category) beside what the user bought strictly before; users' histories join, not lines."""
    m = moments(events, by)
    now = m.select("user_id", F.col("ts").alias("now"), F.col(by).alias("cur"), F.col("n").alias("cur_n"))
    past = m.select("user_id", F.col("ts").alias("then"), F.col(by).alias("past"), F.col("n").alias("past_n"))
    return now.join(past, "user_id").where("then < now")


def past_counts(events: DataFrame, by: str = "category") -> DataFrame:
    """For each purchase time of a user and category: how often each category was bought before."""
    return past_pairs(events, by).groupBy("user_id", "now", "cur", "past").agg(F.sum("past_n").alias("n"))


def soft_votes(events: DataFrame, by: str = "category", scales: dict[str, int] | None = None, with_current: bool = True) -> DataFrame:
    """Votes of past purchases on time slots: slot int(age / size) gets 1, and its k-th neighbours 2^-|k|, for |k| to 3.

    Aggregated to (pair, age) before the scales and neighbours multiply the rows.
    """
    pairs = past_pairs(events, by)
    keys = ["past", "cur"] if with_current else ["past"]
    ages = pairs.groupBy(*keys, (F.col("now") - F.col("then")).alias("age")).agg(F.sum(F.col("past_n") * F.col("cur_n")).alias("w"))
    table = F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(v).cast("long").alias("size")) for k, v in (scales or SCALES).items()])
    slots = ages.select(*keys, "age", "w", F.explode(table).alias("s")).groupBy(*keys, F.col("s.scale").alias("scale"), F.floor(F.col("age") / F.col("s.size")).cast("int").alias("slot")).agg(F.sum("w").alias("w"))
    near = slots.select("*", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))).alias("k"))
    return near.groupBy(*keys, "scale", (F.col("slot") + F.col("k")).alias("idx")).agg(F.round(F.sum(F.col("w") * F.pow(F.lit(2.0), -F.abs("k"))), 6).alias("votes"))


def positions(events: DataFrame, order: list[str]) -> DataFrame:
    """A 0-based position in each user's history, and its length."""
    w = W.partitionBy("user_id")
    return events.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))


def slice_ranges(events: DataFrame, order: list[str], cuts: list[int]) -> DataFrame:
    """First and last position of each user in each slice of time; a slice holds its upper cut."""
    slice_ = F.lit(0)
    for c in cuts:
        slice_ = slice_ + (F.col("ts") > c).cast("int")
    return positions(events, order).withColumn("slice", slice_).groupBy("user_id", "slice").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def head_tail(events: DataFrame, order: list[str], head: float = 0.9) -> DataFrame:
    """part is head for the first floor(head * n) of a user's purchases, else tail."""
    p = positions(events, order)
    return p.withColumn("part", F.when(F.col("idx") < F.floor(F.lit(head) * F.col("total")), "head").otherwise("tail"))


def in_ranges(events: DataFrame, ranges: DataFrame, order: list[str]) -> DataFrame:
    """The purchases at the positions that ``ranges`` (user_id, first_idx, last_idx) names."""
    return positions(events, order).join(ranges, "user_id").where("idx between first_idx and last_idx").drop("first_idx", "last_idx", "total")


def sessions(events: DataFrame) -> DataFrame:
    """A user's items of one time as a sorted list, in the order of time."""
    s = events.groupBy("user_id", "ts").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return s.withColumn("session", F.row_number().over(W.partitionBy("user_id").orderBy("ts")))
