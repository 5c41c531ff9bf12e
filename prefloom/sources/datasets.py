"""Datasets by configuration: files that must exist, splits, a model, and stages that are kept once made."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import readers


@dataclass
class Config:
    """A dataset's name, its files, and the model with its settings."""

    dataset: str
    users: str
    items: str
    ratings: str
    model: str = "HHMF"
    settings: dict[str, Any] = field(default_factory=dict)


@dataclass
class Dataset:
    """Profiles, all ratings (with split: train, test or cs) and accessors of their parts."""

    users: DataFrame
    items: DataFrame
    ratings: DataFrame

    def part(self, split: str) -> DataFrame:
        return self.ratings.where(self.ratings["split"] == split).drop("split")

    def fold(self, k: int, folds: int = 5) -> tuple[DataFrame, DataFrame]:
        """Training and test ratings of the ``k``-th of ``folds``."""
        from ..operators.splits import folds as split

        if not 0 <= k < folds:
            raise ValueError(f"no fold {k} of {folds}")
        rows = split(self.ratings.drop("split"), folds)
        return rows.where(rows["fold"] != k).drop("fold"), rows.where(rows["fold"] == k).drop("fold")


def config(source: str | dict[str, Any]) -> Config:
    """A configuration of a mapping or a file of JSON; keys that are missing, unknown or of another type are an error."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            source = json.load(f)
    known = {f.name for f in fields(Config)}
    if unknown := set(source) - known:
        raise ValueError(f"unknown keys {sorted(unknown)}; there are {sorted(known)}")
    if missing := {"dataset", "users", "items", "ratings"} - set(source):
        raise ValueError(f"missing keys {sorted(missing)}")
    out = Config(**source)
    for name in known - {"settings"}:
        if not isinstance(getattr(out, name), str):
            raise ValueError(f"{name} must be a string")
    if not isinstance(out.settings, dict):
        raise ValueError("settings must be a mapping")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that the session knows is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, c: Config) -> Dataset:
    """Profiles and ratings with their split. Files that aren't there are an error that names them all."""
    from ..operators.splits import train_test_cold

    if gone := [p for p in (c.users, c.items, c.ratings) if not exists(spark, p)]:
        raise FileNotFoundError(f"no such files: {gone}")
    ratings = readers.json_ratings(spark, c.ratings)
    return Dataset(readers.reader(c.dataset, "user")(spark, c.users), readers.reader(c.dataset, "item")(spark, c.items), train_test_cold(ratings))


def process(spark: SparkSession, c: Config) -> Any:
    """The configured model of the dataset's training ratings. Ids of text are numbered by the caller beforehand."""
    from ..models import registry

    return registry.train(c.model, load(spark, c).part("train"), **c.settings)


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What a finished write left at ``path``; if there is none, ``make()`` is written there first.

    A write that was cut off has no _SUCCESS and is made again.
    """
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
