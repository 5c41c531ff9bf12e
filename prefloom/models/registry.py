"""Models by name, their summaries, sweeps over settings, and stored parameters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import baseline, bias, factors

#: Trainers by the names that the model drivers use: each takes ratings and settings.
MODELS: dict[str, Callable[..., Any]] = {
    "POP": lambda ratings, **_: baseline.popular_items(ratings, 50),
    "AVG": lambda ratings, **_: baseline.average_rating(ratings, ratings),
    "BB": lambda ratings, sweeps=5, **_: bias.train(ratings, sweeps),
    "HHMF": lambda ratings, d=5, sweeps=5, user_features=None, item_features=None, **_: factors.train(ratings, d, sweeps, user_features, item_features),
    "HHMFB": lambda ratings, d=5, sweeps=5, user_features=None, item_features=None, **_: factors.train(ratings, d, sweeps, user_features, item_features, biases=True),
}


def train(name: str, ratings: DataFrame, **settings: Any) -> Any:
    if name not in MODELS:
        raise ValueError(f"no model {name}; there are {sorted(MODELS)}")
    return MODELS[name](ratings, **settings)


def sweep(name: str, ratings: DataFrame, grid: dict[str, Iterable[Any]], **fixed: Any) -> list[tuple[dict[str, Any], Any]]:
    """(settings, model) for each combination of ``grid``."""
    keys = list(grid)
    settings = [dict(zip(keys, values)) for values in product(*grid.values())]
    return [(s, train(name, ratings, **fixed, **s)) for s in settings]


def summary(model: Any) -> dict[str, float]:
    """Counts, global bias, variance and training error of a trained model."""
    if isinstance(model, bias.BiasModel):
        error = bias.predict(model, model.ratings).agg(baseline.rmse(F.col("score"), F.col("rating"))).first()[0]
        return {"ratings": model.n, "users": model.users.count(), "items": model.items.count(), "bias": model.g, "variance": 1 / model.precision, "train_rmse": error}
    return {"ratings": model.n, "users": model.users.vectors.count(), "items": model.items.vectors.count(), "bias": model.g, "variance": 1 / model.precision, "train_rmse": model.log[-1]}


def _write_meta(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def save(model: factors.Hybrid | bias.BiasModel | DataFrame, path: str) -> None:
    """Vectors, biases or a baseline's table as Parquet and scalars as one line of JSON."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(f"{path}/vectors")
        return _write_meta(model.sparkSession, path, {"model": "table"})
    if isinstance(model, bias.BiasModel):
        rows = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "mean", "var") for kind, key, df in (("user", "user_id", model.users), ("item", "item_id", model.items))]
        rows[0].unionByName(rows[1]).write.mode("overwrite").parquet(f"{path}/vectors")
        prior = lambda p: [p.mean, p.precision]
        return _write_meta(model.ratings.sparkSession, path, {"model": "BB", "user_prior": prior(model.user_prior), "item_prior": prior(model.item_prior), "g": model.g, "g_var": model.g_var, "precision": model.precision, "n": model.n})
    factors.vectors(model).write.mode("overwrite").parquet(f"{path}/vectors")
    side = lambda s: {"mean": s.mean.tolist(), "precision": s.precision.tolist(), "bias_mean": s.bias_mean, "bias_precision": s.bias_precision, "biased": s.bias is not None}
    meta = {"d": model.d, "g": model.g, "precision": model.precision, "n": model.n, "log": model.log, "weight_precision": model.weight_precision.tolist(), "users": side(model.users), "items": side(model.items), "features": model.weights is not None}
    _write_meta(model.ratings.sparkSession, path, meta)


def load(spark: SparkSession, path: str, ratings: DataFrame | None = None, user_features: DataFrame | None = None, item_features: DataFrame | None = None) -> factors.Hybrid | bias.BiasModel | DataFrame:
    """What ``save`` stored; ``ratings`` and features are needed to train on, not to predict."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    rows = spark.read.parquet(f"{path}/vectors")
    if meta.get("model") == "table":
        return rows
    if meta.get("model") == "BB":
        part = lambda kind: rows.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), "mean", "var")
        return bias.BiasModel(ratings, part("user"), part("item"), bias.Prior(*meta["user_prior"]), bias.Prior(*meta["item_prior"]), meta["g"], meta["g_var"], meta["precision"], meta["n"])

    def side(kind: str, key: str, features: DataFrame | None) -> factors.Side:
        mine, m = rows.where(F.col("kind") == kind), meta[f"{kind}s"]
        biases = mine.select("id", F.col("bias").alias("b"), F.lit(1 / m["bias_precision"]).alias("bv")) if m["biased"] else None
        return factors.Side(key, mine.select("id", "mean", "var"), np.array(m["mean"]), np.array(m["precision"]), features, biases, m["bias_mean"], m["bias_precision"])

    weights = rows.where("kind = 'feature'").select("id", "mean", "var") if meta["features"] else None
    return factors.Hybrid(ratings, meta["d"], side("user", "user_id", user_features), side("item", "item_id", item_features), weights, np.array(meta["weight_precision"]), meta["g"], meta["precision"], meta["n"], meta["log"])


def top_features(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` features whose posterior varies least on average."""
    mean = F.aggregate("var", F.lit(0.0), lambda s, v: s + v) / F.size("var")
    return vectors.where("kind = 'feature'").select("id", mean.alias("variance")).orderBy("variance", "id").limit(k)


def restricted(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """``features`` (id, fid, x) of the ``chosen`` feature ids alone, such as ``top_features``."""
    return features.join(chosen.select(F.col("id").alias("fid")).distinct(), "fid", "left_semi").select(*features.columns)


def feature_prior_mean(vectors: DataFrame) -> list[float]:
    """The mean of the features' vectors; empty without features."""
    rows = vectors.where("kind = 'feature'").select(F.posexplode("mean").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    return [r.m for r in rows.orderBy("k").collect()]


def feature_norms(vectors: DataFrame) -> DataFrame:
    """Length of each feature's vector, with its mean variance."""
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, v: s + v * v))
    return vectors.where("kind = 'feature'").select("id", norm.alias("norm"), (F.aggregate("var", F.lit(0.0), lambda s, v: s + v) / F.size("var")).alias("variance"))
