"""Queries on tables of a test's own: odd values, copies under other keys, and what a plan may not do."""

from __future__ import annotations

import os

import duckdb
import pytest

from prefloom import registry
from prefloom.sources.tables import order_events

from .oracle import TABLES, same


def tables(small: str, folder, **replaced: str) -> str:
    """A folder of the test tables, those of ``replaced`` by the result of a query over them; {t} is the table's file."""
    con = duckdb.connect()
    for t in TABLES:
        file = f"{small}/{t}.parquet"
        if t in replaced:
            con.execute(f"COPY ({replaced[t].format(t=file)}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(file, f"{folder}/{t}.parquet")
    return str(folder)


def check(spark, name: str, d: str) -> None:
    same(spark, name, registry.QUERIES[name], registry.SQL[name], d)


def test_bounds_at_zero(spark, small, tmp_path):
    """Balances of 0 and next to it, missing ones too."""
    odd = "(VALUES (0, 0.0), (1, -0.0), (2, 1e-300), (3, 1e-9), (4, 0.01), (5, -0.01), (6, NULL), (7, 'inf'), (8, '-inf'), (9, 'nan'), (10, -1e9)) v (k, x)"
    d = tables(small, tmp_path, customer="SELECT * REPLACE (x::DOUBLE AS c_acctbal) FROM '{t}' JOIN " + odd + " ON k = c_custkey")
    check(spark, "logistic_bounds", d)


def shuffled(spark, work) -> int:
    """Rows that ``work`` writes to shuffles."""
    sc = spark.sparkContext

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    work()
    return written() - before


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


COPIES = "SELECT * REPLACE (p_partkey + 1000 * k AS p_partkey, CASE WHEN k > 0 THEN 'B' ELSE p_brand END AS p_brand) FROM '{t}', range(20) r (k) WHERE p_type = (SELECT min(p_type) FROM '{t}') OR k = 0"


@pytest.mark.parametrize("name", ["doc_cosine_in_block", "doc_cosine_in_category", "item_bm25_in_block", "item_bm25_in_category"])
def test_similar_copies(spark, small, tmp_path, name):
    """Many items of few names: the SQL's rows, and no pairs in a shuffle."""
    d = tables(small, tmp_path, part=COPIES)
    check(spark, name, d)
    parts = spark.read.parquet(f"{d}/part.parquet")
    keys = ["p_type", "p_brand"] if name.endswith("block") else ["p_type"]
    pairs = parts.groupBy(*keys).count().selectExpr("sum(count * count)").first()[0]
    assert shuffled(spark, lambda: run(registry.QUERIES[name](spark, d))) < pairs / 10


@pytest.mark.parametrize("name", ["doc_cosine_in_category", "item_bm25_in_category"])
def test_pairs_leave_flat(spark, small, name):
    """Pairs come out of their tasks as rows: no arrays of lists are exploded after."""
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    after, made, _ = plan.partition("FlatMapGroupsInArrow")
    assert made and "Generate" not in after


def test_pairs_of_lists(monkeypatch):
    """Every document of a wording with its list but itself, whatever the sizes of pieces; a place beyond the list leaves it whole."""
    import numpy as np

    from prefloom.operators import similarity

    b, score = np.array([7, 3, 9, 1, 5]), np.array([0.9, 0.9, 0.5, 0.2, 0.0])
    a, at = np.array([3, 5, 7, 8]), np.array([1, 4, 0, 5])
    want = []
    for x in a:
        left = [k for k in range(5) if b[k] != x]
        want += [(x, b[k], score[k], rank) for rank, k in enumerate(left, 1)]
    for pairs in (1, 3, 8, 100):
        for members in (1, 3, 100):
            monkeypatch.setattr(similarity, "PAIRS", pairs)
            monkeypatch.setattr(similarity, "MEMBERS", members)
            pieces = list(similarity._pairs(a, at, b, score))
            assert all(len(p[0]) <= max(pairs, min(members, 4)) for p in pieces)
            assert sorted(r for p in pieces for r in zip(*p)) == sorted(want)


@pytest.mark.parametrize("name", ["user_unseen_items", "prediction_rows"])
def test_items_of_queries(spark, small, tmp_path, name, monkeypatch):
    """Users who have bought nothing, all, the first and the last item of a block; the pairs pass no shuffle."""
    from prefloom.operators import features, samples

    for module, what, n in ((samples, "ITEMS", 64), (features, "QUERIES", 8)):
        monkeypatch.setattr(module, what, n, raising=False)
    orders = "SELECT * REPLACE (CASE WHEN o_orderkey < 20 THEN 50 WHEN o_orderkey < 40 THEN 100 WHEN o_custkey IN (50, 100, 0) THEN 1 ELSE o_custkey END AS o_custkey) FROM '{t}'"
    lines = "SELECT * FROM '{t}' UNION ALL SELECT l.* REPLACE (p AS l_partkey, CASE WHEN p IN (0, 63, 64, 127, 128) AND odd THEN 25 ELSE 5 END AS l_orderkey) FROM (FROM '{t}' LIMIT 1) l, range(200) r (p), (VALUES (true), (false)) v (odd)"
    d = tables(small, tmp_path, orders=orders, lineitem=lines, customer="SELECT * REPLACE (c_custkey * 10 AS c_custkey) FROM '{t}'")
    check(spark, name, d)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables beyond it
    try:
        made = registry.QUERIES[name](spark, d)
        events = shuffled(spark, lambda: run(order_events(spark, d)))
        assert shuffled(spark, lambda: run(made)) - events < made.count() / 2
        assert "CartesianProduct" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_unseen_of_every_user(spark, small):
    """All customers, not a stated set of them."""
    made = registry.QUERIES["user_unseen_items"](spark, small)
    assert made.select("user_id").distinct().count() == spark.read.parquet(f"{small}/customer.parquet").count()


def test_unseen_of_odd_keys(spark, small, tmp_path):
    """Repeated and missing keys on either side are rows of their own."""
    key = "SELECT * REPLACE (CASE {k} WHEN 3 THEN NULL WHEN 5 THEN 4 ELSE {k} END AS {k}) FROM '{{t}}'"
    d = tables(small, tmp_path, customer=key.format(k="c_custkey"), part=key.format(k="p_partkey"))
    check(spark, "user_unseen_items", d)


def stored(made, folder) -> float:
    """Bytes of Parquet a row."""
    made.coalesce(1).write.parquet(f"{folder}/out")
    n = made.sparkSession.read.parquet(f"{folder}/out").count()
    return sum(os.path.getsize(f"{folder}/out/{x}") for x in os.listdir(f"{folder}/out") if x.endswith(".parquet")) / n


@pytest.mark.parametrize("name, users, items", [("user_unseen_items", 1, 120), ("prediction_rows", 120, 1)])
def test_pairs_in_little(spark, small, tmp_path, name, users, items):
    """Pairs come in an order that Parquet stores in under a byte a row, though a side has nearly as many keys as a page has rows."""
    copies = "SELECT * REPLACE (50 * ({k} + 1000 * k) AS {k}) FROM '{{t}}', range({n}) r (k)"
    d = tables(small, tmp_path, customer=copies.format(k="c_custkey", n=users), part=copies.format(k="p_partkey", n=items))
    assert stored(registry.QUERIES[name](spark, d), tmp_path) < 1


def test_unseen_by_bias(spark):
    """Equal biases, biases that six digits make equal, and users who have rated none, some and nearly all."""
    from prefloom.models import baseline, bias

    items = [(i, (0.5, 0.5 + 3e-7 * (i % 4), -0.1 * (i % 7), i / 97)[i % 4], 1.0) for i in range(120)]
    best = sorted(items, key=lambda x: -x[1])
    rated = [(1, i) for i, _, _ in best[:40]] + [(2, i) for i in range(118)] + [(3, i) for i in range(0, 120, 4)]
    r = spark.createDataFrame([(u, i, 3.0) for u, i in rated], "user_id long, item_id long, rating double")
    i = spark.createDataFrame(items, "item_id long, mean double, var double")
    u = spark.createDataFrame([(k, 0.1 * k, 1.0) for k in range(5)], "user_id long, mean double, var double")
    m = bias.BiasModel(r, u, i, bias.Prior(), bias.Prior(), 3.0000003, 0.0, 1.0, len(rated))
    from pyspark.sql import functions as F

    pairs = u.select("user_id").crossJoin(i.select("item_id")).join(r, ["user_id", "item_id"], "left_anti")
    want = baseline.top_predictions(bias.predict(m, pairs).withColumn("score", F.round("score", 6)), 5)
    columns = ["user_id", "item_id", "score", "rank"]
    got = bias.recommend(m, u, 5).select(*columns).collect()
    assert sorted(got) == sorted(want.select(*columns).collect()) and len(got) == 4 * 5 + 2


def test_als_for_queries(spark, small):
    """A stated set of users has the lists that it has among all users, to the last digits of float."""
    from prefloom.models import linear

    events = order_events(spark, small)
    asked = events.where("user_id % 50 = 0").select("user_id").distinct()
    lists = lambda df: {(r.user_id, r["rank"]): r.score for r in df.where("user_id % 50 = 0").collect()}
    got = lists(linear.implicit_als(events, 4, 2, asked))
    assert got == pytest.approx(lists(linear.implicit_als(events, 4, 2)), abs=1e-5) and len(got) == 10 * asked.count()
    assert registry.QUERIES["als_implicit"](spark, small).where("user_id % 50 <> 0").count() == 0
