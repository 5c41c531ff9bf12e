"""Hand-computed fixtures and edge cases of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from prefloom.functions import scalars as x
from prefloom.operators import features as f, graph as g, history as h, popularity as p, similarity as s, splits

from .conftest import rows

RATINGS = [("u1", "i1", 5.0, 100), ("u1", "i2", 3.0, 200), ("u2", "i1", 4.0, 150), ("u2", "i3", 2.0, 160), ("u3", "i1", 1.0, 50)]
SCHEMA = "user_id string, item_id string, rating double, ts long"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_popularity_and_rmse(spark):
    r = spark.createDataFrame(RATINGS, SCHEMA)
    assert rows(p.popularity(r, "item_id")) == [("i1", 3, 3.333333, 1.0), ("i2", 1, 3.0, 0.333333), ("i3", 1, 2.0, 0.333333)]
    from prefloom.models.baseline import average_rating

    assert average_rating(r, r).first()["train_rmse"] == pytest.approx(math.sqrt(2))


def test_popularity_of_nothing(spark):
    r = spark.createDataFrame([], SCHEMA)
    assert rows(p.popularity(r, "item_id")) == []
    assert rows(p.popularity(spark.createDataFrame([("u", None, None, None)], SCHEMA), "item_id")) == []


def test_folds(spark):
    r = spark.createDataFrame(RATINGS, SCHEMA)
    assert [t[-1] for t in sorted(tuple(z) for z in splits.folds(r).select("user_id", "item_id", "fold").collect())] == [0, 1, 2, 3, 4]


def test_split_sizes(spark):
    users = spark.range(8).withColumnRenamed("id", "user_id")
    assert sorted(r.part for r in splits.split_users(users, exact=True).collect()) == [1] * 6 + [2] * 2
    r = spark.range(5).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"))
    assert sorted(t.part for t in splits.split_ratings(r).collect()) == [1, 1, 1, 2, 2]
    e = spark.range(11).select(F.lit(1).alias("user_id"), F.col("id").alias("ts"))
    assert [t.part for t in h.head_tail(e, ["ts"]).orderBy("idx").collect()] == ["head"] * 9 + ["tail"] * 2


def test_soft_vote(spark):
    e = spark.createDataFrame([(1, 0, "A"), (1, 10 * h.DAY, "B")], "user_id long, ts long, category string")
    got = {(r.scale, r.idx): r.votes for r in h.soft_votes(e).where("past = 'A' and cur = 'B'").collect()}
    assert [got["day", i] for i in range(7, 14)] == [0.125, 0.25, 0.5, 1, 0.5, 0.25, 0.125]
    assert got["week", 1] == 1 and len(got) == 63


@pytest.mark.parametrize("values, want", [([2.0, 4.0, 10.0], [0.2, 0.4, 1.0]), ([-2.0, 4.0], [0.0, 1.0]), ([0.0, 0.0], [None, None])])
def test_min_max(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.s for r in p.min_max(df, "v", "s").orderBy("i").collect()] == want


def test_required_features(spark):
    df = spark.createDataFrame([(1, "Foo  Bar", 0, None)], "id long, br string, sp int, pop double")
    handlers = {"br": "categorical", "sp": "numeric", "pop": "numeric", "ar": "numeric"}
    got = {r.name: r.value for r in f.entity_features(df, "id", "i", handlers, list(handlers)).collect()}
    assert got == {"i_br_foo bar": 1.0, "i_sp#miss": 1.0, "i_pop#miss": 1.0, "i_ar#miss": 1.0}


def test_repurchase_tendency(spark):
    df = spark.createDataFrame([("X", 1), ("X", 1), ("X", 2), ("Y", 3), ("Y", 3)], "category string, user_id long")
    assert rows(p.repurchase_tendency(df, "category")) == [("X", 3, 2, 1.0), ("Y", 2, 1, 0.0)]


def test_cosine(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "a c"), (4, ""), (5, None)], "id long, t string")
    w = s.tfidf(s.terms(d, "id", "t"), "id")
    got = {(r.a, r.b): r.score for r in s.similar_in_block(w, d.withColumn("k", F.lit("k")), "id", "k", 5).collect()}
    assert got[1, 3] == pytest.approx(0.565685) and got[1, 2] == pytest.approx(0.424264) and got[2, 3] == pytest.approx(0.5)


def test_all_pairs_of_a_block(spark):
    """By brute force: more than five neighbours, of other brands too, and those without a common term."""
    texts = ["red ring", "red bolt", "red gear ring", "blue bolt", "blue gear", "hot ring", "hot red bolt", "", None]
    d = spark.createDataFrame([(k, t, "c" if k != 3 else "other") for k, t in enumerate(texts)], "id long, t string, c string")
    terms = {k: t.split() for k, t in enumerate(texts) if t}
    df = {w: sum(w in t for t in terms.values()) for t in terms.values() for w in t}
    v = {k: {w: math.log(len(terms) / df[w]) for w in t} for k, t in terms.items()}
    dot = lambda a, b: sum(x * v[b].get(w, 0) for w, x in v[a].items()) if a in v and b in v else 0
    block = [k for k in range(len(texts)) if k != 3]
    got = s.similar_in_block(s.tfidf(s.terms(d, "id", "t"), "id"), d, "id", "c", None).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in block for b in block if a != b} and len(got) == 8 * 7
    for r in got:
        assert r.score == pytest.approx(dot(r.a, r.b) and dot(r.a, r.b) / math.sqrt(dot(r.a, r.a) * dot(r.b, r.b)), abs=2e-6)
    for a in block:
        mine = sorted((r for r in got if r.a == a), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 8)) and [(-r.score, r.b) for r in mine] == sorted((-r.score, r.b) for r in mine)


def test_negatives_are_complete(spark):
    """Users who have half, most and nearly all of a catalogue, and a small one; the first draws stay as they were."""
    have = {1: 100, 2: 120, 3: 199, 4: 200, 5: 3}
    seen = spark.createDataFrame([(u, i) for u, k in have.items() for i in range(k)], "user_id long, item_id long")
    items = spark.createDataFrame([(i, i) for i in range(200)], "item_no long, item_id long")
    for ratio in (1, 3):
        got = splits.negatives(seen, items, ratio).collect()
        for u, k in have.items():
            mine = {r.item_id: r["rank"] for r in got if r.user_id == u}
            assert len(mine) == min(ratio * k, 200 - k) and all(i >= k for i in mine), (u, ratio)
            assert sorted(mine.values()) == list(range(1, len(mine) + 1)) and len(mine) == sum(r.user_id == u for r in got)


def test_category_paths(spark):
    path = F.lit("10-Leaf/20-Mid/30-Root|11-L2/20-Mid")
    assert sorted(one(spark, x.node_ids(x.category_nodes(path)))) == ["10", "11", "20", "30"]
    assert sorted(one(spark, x.category_nodes(path, 2))) == ["10-Leaf", "11-L2", "20-Mid"]
    assert one(spark, x.depth_features(F.array(F.lit("A"), F.lit("B")), F.lit("C"))) == ["i_c1_A", "i_c-3_A", "i_c2_B", "i_c-2_B", "i_c3_C", "i_c-1_C"]
    assert one(spark, x.category_prefixes(F.lit("Baby|Feeding|Bottles"))) == ["i_1c_Baby", "i_2c_Baby|Feeding", "i_3c_Baby|Feeding|Bottles"]


def test_gaps(spark):
    e = spark.createDataFrame([(1, 0, "A"), (1, 10 * h.DAY, "A"), (1, 4 * h.DAY, "B")], "user_id long, ts long, category string")
    assert [r.days for r in p.repurchase_intervals(e).collect()] == [10.0]
    gaps = p.first_purchase_gaps(e)
    assert {(r.from_c, r.to_c): r.days for r in gaps.collect()} == {("A", "B"): 4.0, ("B", "A"): -4.0}
    assert rows(p.order_scores(gaps)) == [("A", 0.0), ("B", 1.0)]


def test_first_edges(spark):
    e = spark.createDataFrame([(1, 2, 8, 5.0, 0), (1, 2, 8, 3.0, 1), (2, 1, 8, 4.0, 2)], "from_id long, to_id long, type int, value double, at int")
    assert rows(g.first_edges(e, ["at"])) == [(1, 2, 8, 5.0, 0)]
    assert len(rows(g.both_ways(g.first_edges(e, ["at"])))) == 2


def test_composite_keys(spark):
    assert one(spark, x.composite_key(F.lit(3), F.lit("gender_male"))) == "3_gender_male"
    kind, name = x.split_key(F.lit("3_gender_male"))
    assert (one(spark, kind), one(spark, name)) == (3, "gender_male")


def test_rule_interactions(spark):
    row = [(1, [("u_1", 1, 2.0), ("i_4", 4, 3.0), ("i_5", 5, 0.5)]), (2, [("u_1", 1, 2.0)])]
    df = spark.createDataFrame(row, "id long, features array<struct<name string, fid long, value double>>")
    got = {r.id: {c.name: c.value for c in r.int} for r in f.rule_interactions(df, {"U": "^u", "I": "^i"}, ["U", "I"]).collect()}
    assert got == {1: {"int_1_4": 6.0, "int_1_5": 1.0}, 2: {}}
    with pytest.raises(ValueError):
        f.rule_interactions(df, {}, ["U"])


def test_scalars(spark):
    assert one(spark, x.attribute_map(F.lit("Color: Red|size:XL|color:blue|bad"))) == {"size": "xl", "color": "blue"}
    assert one(spark, x.title_year(F.lit("Heat (1995)"))) == 1995 and one(spark, x.title_year(F.lit("Heat"))) is None
    assert one(spark, x.year_offset(F.lit("2008-1-2"))) == 108
    assert one(spark, x.age_range_bucket(F.lit("25_34"))) == 5
    assert one(spark, x.bound_lambda(F.lit(0.0))) == 0.125
    assert one(spark, x.gender_sign(F.lit("Female"))) == -1.0
    value, share = x.with_confidence(F.lit("male_98"))
    assert (one(spark, value), one(spark, share)) == ("male", 0.98)


def test_dictionary_grows(spark):
    old = spark.createDataFrame([("b", 1)], "name string, fid long")
    new = spark.createDataFrame([("c",), ("a",), ("b",), (None,)], "name string")
    assert rows(f.extend_dictionary(old, new)) == [("a", 2), ("b", 1), ("c", 3)]


def test_upsert(spark):
    old = spark.createDataFrame([(0, 1, "a", "x")], "entity_id long, type int, name string, desc string")
    new = spark.createDataFrame([(1, "a", ""), (2, "a", "y"), (1, "b", None)], "type int, name string, desc string")
    assert rows(g.upsert_entities(old, new)) == [(0, 1, "a", "x"), (1, 1, "b", None), (2, 2, "a", "y")]


def test_paths(spark):
    t = spark.createDataFrame([(1, "r", None), (2, "m", 1), (3, "l", 2)], "node long, name string, parent long")
    assert rows(g.ancestors(t)) == [(1, "r"), (2, "r/m"), (3, "r/m/l")]


def test_merge_and_links(spark):
    a = spark.createDataFrame([("1", {"p": "1", "q": "2"})], "id string, attrs map<string,string>")
    b = spark.createDataFrame([("1", {"q": "3"}), ("2", {"q": "4"})], "id string, attrs map<string,string>")
    assert {r.id: r.attrs for r in p.merge_attributes([a, b]).collect()} == {"1": {"p": "1", "q": "3"}, "2": {"q": "4"}}
    links = spark.createDataFrame([(1, 5, None, 0), (1, 6, None, 1), (2, None, 7, 0)], "rating_id long, user_id long, item_id long, at int")
    assert rows(g.last_link(links, "at")) == [(1, 6, 0), (2, 0, 7)]
