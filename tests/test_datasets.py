"""Configurations, loaders, kept stages, stored models and their files."""

from __future__ import annotations

import json

import pytest

from prefloom.models import bias, factors, registry
from prefloom.operators import graph
from prefloom.sources import datasets, sinks

R = [(u, i, float((u * 3 + i * 2) % 5 + 1)) for u in range(8) for i in range(6) if (u + i) % 3]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(R, "user_id long, item_id long, rating double")


def test_config(tmp_path):
    good = {"dataset": "amazon", "users": "a", "items": "b", "ratings": "c", "model": "BB", "settings": {"sweeps": 1}}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert datasets.config(str(tmp_path / "c.json")) == datasets.config(good)
    for bad in ({**good, "more": 1}, {"dataset": "amazon"}, {**good, "model": 3}, {**good, "settings": []}):
        with pytest.raises(ValueError):
            datasets.config(bad)


def test_load_and_process(spark, tmp_path):
    for name, rows in (("users", [{"id": str(u)} for u in range(8)]), ("items", [{"id": str(i)} for i in range(6)]), ("ratings", [{"u": str(u), "i": str(i), "r": str(r)} for u, i, r in R])):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    c = datasets.config({"dataset": "amazon", **{n: str(tmp_path / n) for n in ("users", "items", "ratings")}, "model": "BB", "settings": {"sweeps": 1}})
    data = datasets.load(spark, c)
    parts = [data.part(s).count() for s in ("train", "test", "cs")]
    assert sum(parts) == len(R) and parts[0] and data.users.count() == 8 and data.items.count() == 6
    train, test = data.fold(1)
    assert train.count() + test.count() == len(R) and test.count() == len(range(1, len(R), 5))
    with pytest.raises(ValueError):
        data.fold(5)
    (tmp_path / "items").unlink()
    with pytest.raises(FileNotFoundError, match="items"):
        datasets.load(spark, c)


def test_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert datasets.kept(spark, path, make).count() == datasets.kept(spark, path, make).count() == 3 and made == [1]
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert datasets.kept(spark, path, make).count() == 3 and made == [1, 1]


def test_stored_models(spark, ratings, tmp_path):
    m = bias.train(ratings, 1, 2)
    registry.save(m, str(tmp_path / "bb"))
    pairs = ratings.select("user_id", "item_id").union(spark.createDataFrame([(99, 0)], "user_id long, item_id long"))
    score = lambda x: {(r.user_id, r.item_id): r.score for r in bias.predict(x, pairs).collect()}
    assert score(registry.load(spark, str(tmp_path / "bb"))) == pytest.approx(score(m))
    top = registry.train("POP", ratings)
    registry.save(top, str(tmp_path / "pop"))
    assert sorted(registry.load(spark, str(tmp_path / "pop")).collect()) == sorted(top.collect())


def test_chosen_features(spark, ratings):
    x = spark.createDataFrame([(u, 1 + k, 1.0) for u in range(8) for k in range(3) if (u + k) % 2], "id long, fid long, x double")
    m = factors.train(ratings, 2, 1, x)
    v = factors.vectors(m)
    chosen = registry.top_features(v, 2)
    few = registry.restricted(x, chosen)
    assert {r.fid for r in few.collect()} == {r.id for r in chosen.collect()} and len({r.fid for r in few.collect()}) == 2
    means = [r["mean"] for r in m.weights.collect()]
    assert registry.feature_prior_mean(v) == pytest.approx([sum(c) / 3 for c in zip(*means)])
    assert registry.feature_prior_mean(factors.vectors(factors.train(ratings, 2, 1))) == []


def test_splits_written(spark, ratings, tmp_path):
    from prefloom.operators.splits import train_test_cold

    rows = train_test_cold(ratings)
    sinks.write_splits(rows, str(tmp_path / "s"))
    back = spark.read.option("sep", "\t").csv(str(tmp_path / "s"))
    want = sorted((str(r.user_id), str(r.item_id), r.split) for r in rows.collect())
    assert sorted(tuple(r) for r in back.collect()) == want


def test_histograms(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, None), (None, ["a", None])], "year int, genres array<string>")
    assert sorted(tuple(r) for r in graph.histograms(rows, ["year", "genres"]).collect()) == [("genres", "a", 2), ("genres", "b", 1), ("year", "1", 2)]
    assert graph.histograms(rows.limit(0), ["year"]).count() == 0
