"""Models against closed forms and numpy."""

from __future__ import annotations

import numpy as np
import pytest

from prefloom.models import baseline, bias, factors
from prefloom.streaming import activity

R = [(u, i, float((u * 3 + i * 2) % 5 + 1)) for u in range(8) for i in range(6) if (u + i) % 3]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(R, "user_id long, item_id long, rating double")


def test_user_update(spark):
    r = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0)], "user_id long, item_id long, rating double")
    items = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0)], "item_id long, mean double, var double")
    m = bias.BiasModel(r, items, items, bias.Prior(), bias.Prior(), 0.0, 0.0, 1.0, 2)
    got = bias.posterior(m, "user_id", "item_id", items, bias.Prior(0.0, 1.0)).first()
    assert (got["mean"], got["var"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3))


def test_alternation(ratings):
    g, u, i = bias.alternate(ratings, 20)
    bu, bi = {x: 0.0 for x in range(8)}, {x: 0.0 for x in range(6)}
    for _ in range(20):
        m = np.mean([r - bu[a] - bi[b] for a, b, r in R])
        for a in bu:
            bu[a] = np.mean([r - m - bi[y] for x, y, r in R if x == a])
        for b in bi:
            bi[b] = np.mean([r - m - bu[x] for x, y, r in R if y == b])
    assert g == pytest.approx(m)
    assert {r.user_id: r.bu for r in u.collect()} == pytest.approx(bu)
    assert {r.item_id: r.bi for r in i.collect()} == pytest.approx(bi)


def test_bias_model(ratings):
    m = bias.train(ratings, 3, 5)
    scored = bias.predict(m, ratings)
    error = np.sqrt(np.mean([(r.score - r.rating) ** 2 for r in scored.collect()]))
    assert error < np.std([r for _, _, r in R]) and m.precision > 0
    new = ratings.sparkSession.createDataFrame([(99, 0)], "user_id long, item_id long")
    assert bias.predict(m, new).first().score is not None


def test_posterior_solves(spark):
    """The d x d posterior equals numpy's for each entity."""
    d = 2
    edges = spark.createDataFrame([(1, [1.0, 2.0], [0.5, 0.25], 2.0, 3.0), (1, [0.0, 1.0], [1.0, 1.0], 1.0, -1.0)], "id long, mean array<double>, var array<double>, weight double, target double")
    ids = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, -1.0])], "id long, c array<double>")
    from pyspark.sql import functions as F

    got = {r.id: r for r in factors.solved(ids, factors.messages(edges, d), d, np.ones(d), F.col("c")).collect()}
    a = 2 * (np.outer([1, 2], [1, 2]) + np.diag([0.5, 0.25])) + np.outer([0, 1], [0, 1]) + np.eye(2) + np.eye(2)
    b = 3 * np.array([1, 2]) - np.array([0, 1])
    assert got[1]["mean"] == pytest.approx(np.linalg.solve(a, b)) and got[1]["var"] == pytest.approx(np.diag(np.linalg.inv(a)))
    assert got[2]["mean"] == pytest.approx([1, -1]) and got[2]["var"] == pytest.approx([1, 1])


def test_hybrid(spark, ratings):
    feats = spark.createDataFrame([(u, 1 + u % 2, 1.0) for u in range(8)], "id long, fid long, x double")
    m = factors.train(ratings, 2, 4, feats, None, biases=True)
    assert m.log[-1] <= np.std([r for _, _, r in R]) and m.precision > 0
    assert factors.vectors(m).count() == 8 + 6 + 2
    scored = factors.predict(m, spark.createDataFrame([(0, 0), (99, 1)], "user_id long, item_id long"), spark.createDataFrame([(99, 1, 1.0)], "id long, fid long, x double"))
    assert all(r.score is not None for r in scored.collect())


def test_registry(spark, ratings, tmp_path):
    from prefloom.models import registry

    feats = spark.createDataFrame([(u, 1 + u % 2, 1.0) for u in range(8)], "id long, fid long, x double")
    m = registry.train("HHMFB", ratings, d=2, sweeps=1, user_features=feats)
    registry.save(m, str(tmp_path / "m"))
    again = registry.load(spark, str(tmp_path / "m"), ratings, feats)
    score = lambda x: {(r.user_id, r.item_id): r.score for r in factors.predict(x, ratings).collect()}
    assert score(again) == pytest.approx(score(m))
    assert registry.summary(m)["users"] == 8 and registry.top_features(factors.vectors(m), 1).count() == 1
    assert [s for s, _ in registry.sweep("POP", ratings, {"a": [1, 2]})] == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError):
        registry.train("none", ratings)


@pytest.mark.parametrize("logistic", [False, True])
def test_implicit(spark, ratings, logistic):
    feats = spark.createDataFrame([(u, k, float((u + k) % 2)) for u in range(8) for k in range(3)], "id long, fid long, x double")
    vectors, log = factors.implicit(ratings, feats, 2, 3, logistic)
    assert vectors.count() == 8 + 6 + 3 and log[-1] <= log[0] + 0.05


def test_no_ratings(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, rating double")
    with pytest.raises(ValueError):
        bias.train(none)
    with pytest.raises(ValueError):
        factors.train(none)


def test_folds_by_sums(spark):
    rows = [(k % 2, float(r)) for k, (_, _, r) in enumerate(R)]
    got = {r.fold: r for r in baseline.cross_validated(spark.createDataFrame(rows, "fold int, rating double")).collect()}
    for fold in (0, 1):
        train, test = [r for k, r in rows if k != fold], [r for k, r in rows if k == fold]
        assert got[fold].test_rmse == pytest.approx(np.sqrt(np.mean((np.array(test) - np.mean(train)) ** 2)))


def test_stream(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.mode("append").parquet(str(tmp_path / "in"))
    stream = activity.counts(activity.source(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("activity_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = spark.read.parquet(f"{small}/events.parquet").count()
    assert spark.sql("select sum(n) from activity_out").first()[0] == want
