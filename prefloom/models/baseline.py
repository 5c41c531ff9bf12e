"""Popularity and average baselines, evaluation, registry of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.graph import ranked
from ..operators.popularity import rmse


def popular_items(ratings: DataFrame, top: int = 20) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "item_id").limit(top)


def average_rating(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the mean rating of ``train`` and the errors of predicting it."""
    mean = F.broadcast(train.agg(F.avg("rating").alias("mean")))
    error = lambda df, name: df.crossJoin(mean).agg(F.first("mean").alias("mean"), rmse(F.col("mean"), F.col("rating")).alias(name))
    return error(train, "train_rmse").crossJoin(error(test, "test_rmse").drop("mean"))


def cross_validated(folded: DataFrame) -> DataFrame:
    """Train and test error of the average in each fold, all folds in one pass.

    A fold's training sums are the totals less its own.
    """
    f = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q"))
    t = F.broadcast(f.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q")))
    c = f.crossJoin(t).withColumn("mean", (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")))
    error = lambda n, s, q: F.sqrt((q - 2 * F.col("mean") * s + n * F.col("mean") * F.col("mean")) / n)
    return c.select("fold", "mean", error(F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")).alias("train_rmse"), error(F.col("n"), F.col("s"), F.col("q")).alias("test_rmse"))


def top_predictions(scores: DataFrame, top: int = 50) -> DataFrame:
    """The best of each user's (user_id, item_id, score), ties by item."""
    return ranked(scores, ["user_id"], [F.desc("score"), "item_id"], top)
