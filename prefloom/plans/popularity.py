"""Counts and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g, popularity as op
from ..sources.tables import items, order_events, table, users
from .base import query


@query("SELECT item_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS popularity FROM ev GROUP BY item_id")
def item_popularity_norm(spark, d):
    return op.popularity(order_events(spark, d), "item_id")


@query("SELECT brand, count(*) AS n, round(avg(rating), 6) AS mean_rating, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS popularity FROM ev WHERE brand IS NOT NULL GROUP BY brand")
def brand_popularity_norm(spark, d):
    return op.popularity(order_events(spark, d), "brand")


@query(""", i AS (SELECT category, item_id, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT category, count(*) AS cn FROM ev GROUP BY ALL)
SELECT category, item_id, n, round(n::DOUBLE / (SELECT max(n) FROM i), 6) AS item_popularity,
  round(n::DOUBLE / max(n) OVER (PARTITION BY category), 6) AS share_in_category, round(cn::DOUBLE / (SELECT max(cn) FROM c), 6) AS category_popularity
FROM i JOIN c USING (category)""")
def category_item_share(spark, d):
    return op.category_share(order_events(spark, d))


@query(""", e AS (SELECT item_id, category, year(to_timestamp(ts) AT TIME ZONE 'UTC')::INT AS y, month(to_timestamp(ts) AT TIME ZONE 'UTC')::INT AS m FROM ev)
SELECT CASE WHEN item_id IS NOT NULL THEN 'i' ELSE 'c' END || CASE WHEN m IS NOT NULL THEN 'pym' WHEN y IS NOT NULL THEN 'py' ELSE 'p' END AS level, item_id, category, y, m, count(*) AS n
FROM e GROUP BY GROUPING SETS ((item_id), (item_id, y), (item_id, y, m), (category), (category, y), (category, y, m))""")
def freq_grouping_sets(spark, d):
    return op.frequencies(order_events(spark, d))


_TENDENCY = ", t AS (SELECT {by}, count(*) AS orders, count(DISTINCT user_id) AS users, count(*) * ln(count(DISTINCT user_id)) / count(DISTINCT user_id) AS raw FROM ev GROUP BY {by}) SELECT {by}, orders, users, round(raw / nullif((SELECT max(raw) FROM t), 0), 6) AS tendency FROM t"


@query(_TENDENCY.format(by="item_id"))
def repurchase_tendency(spark, d):
    return op.repurchase_tendency(order_events(spark, d), "item_id")


@query(_TENDENCY.format(by="category"))
def repurchase_tendency_category(spark, d):
    return op.repurchase_tendency(order_events(spark, d), "category")


@query("SELECT user_id, category, round((max(ts) - min(ts)) / 86400.0, 3)::DOUBLE AS days FROM ev GROUP BY user_id, category HAVING max(ts) > min(ts)")
def category_life_span(spark, d):
    return op.life_span(order_events(spark, d))


@query(""", t AS (SELECT DISTINCT user_id, category, ts FROM ev), l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, category ORDER BY ts) AS s FROM t)
SELECT user_id, category, ts, round(s / 86400.0, 3)::DOUBLE AS days FROM l WHERE s IS NOT NULL""")
def repurchase_intervals(spark, d):
    return op.repurchase_intervals(order_events(spark, d))


_GAPS = ", f AS (SELECT user_id, category, min(ts) AS ts FROM ev GROUP BY ALL), g AS (SELECT a.user_id, a.category AS from_c, b.category AS to_c, round((b.ts - a.ts) / 86400.0, 3)::DOUBLE AS days FROM f a JOIN f b ON a.user_id = b.user_id AND a.category <> b.category)"


@query(_GAPS + " SELECT * FROM g")
def category_pair_gaps(spark, d):
    return op.first_purchase_gaps(order_events(spark, d))


@query(_GAPS + ", s AS (SELECT from_c, to_c, avg(CASE WHEN days >= 0 THEN 1.0 ELSE 0.0 END) AS share FROM g GROUP BY ALL) SELECT to_c, round(sum(share), 6) AS score FROM s GROUP BY to_c")
def category_order_score(spark, d):
    return op.order_scores(op.first_purchase_gaps(order_events(spark, d)))


@query(", c AS (SELECT segment, item_id, count(*) AS n FROM ev JOIN us USING (user_id) WHERE segment IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, item_id) AS rank FROM c")
def segment_item_counts(spark, d):
    return op.segment_counts(order_events(spark, d), users(spark, d))


@query("SELECT user_id, count(*) AS n FROM ev GROUP BY user_id HAVING count(*) >= 5 AND count(*) < 200")
def active_user_filter(spark, d):
    return order_events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5 and n < 200")


@query("SELECT user_id, item_id, order_id, rating FROM ev WHERE item_id IN (SELECT item_id FROM it WHERE category = 'PROMO') AND user_id IN (SELECT user_id FROM us WHERE segment = 'FURNITURE')")
def rating_semi_filter(spark, d):
    e = order_events(spark, d).select("user_id", "item_id", "order_id", "rating")
    e = e.join(items(spark, d).where("category = 'PROMO'"), "item_id", "left_semi")
    return e.join(users(spark, d).where("segment = 'FURNITURE'"), "user_id", "left_semi").select("user_id", "item_id", "order_id", "rating")


@query("SELECT item_id, name FROM it WHERE item_id NOT IN (SELECT item_id FROM ev WHERE rating = 5)")
def unseen_items_anti(spark, d):
    return items(spark, d).join(order_events(spark, d).where("rating = 5"), "item_id", "left_anti").select("item_id", "name")


@query("SELECT user_id, (SELECT count(*) FROM it) - count(DISTINCT item_id) AS unseen FROM ev GROUP BY user_id")
def unseen_item_counts(spark, d):
    total = F.broadcast(items(spark, d).agg(F.count("*").alias("total")))
    seen = order_events(spark, d).groupBy("user_id").agg(F.countDistinct("item_id").alias("seen"))
    return seen.crossJoin(total).select("user_id", (F.col("total") - F.col("seen")).alias("unseen"))


@query("SELECT item_id, n, name FROM (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20) JOIN it USING (item_id)")
def top_popular_items(spark, d):
    top = order_events(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(20)
    return top.join(items(spark, d), "item_id").select("item_id", "n", "name")


@query(", s AS (SELECT item_id, category, price FROM it), m AS (SELECT category, least(0, min(price)) AS lo, greatest(0, max(price)) AS hi FROM s GROUP BY category) SELECT item_id, category, round((price - lo) / nullif(hi - lo, 0), 6) AS scaled FROM s JOIN m USING (category)")
def minmax_scale(spark, d):
    return op.min_max(items(spark, d).select("item_id", "category", "price"), "price", "scaled", ["category"]).select("item_id", "category", "scaled")


@query("SELECT n, count(*) AS items FROM (SELECT count(*) AS n FROM ev GROUP BY item_id) GROUP BY n")
def popularity_histogram(spark, d):
    return order_events(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("items"))


@query("SELECT category, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM it GROUP BY category")
def category_item_lists(spark, d):
    out = op.collected(items(spark, d), "category", "item_id", "items")
    return out.select("category", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT year(to_timestamp(ts) AT TIME ZONE 'UTC')::INT AS y, category, count(*) AS n FROM ev WHERE category = 'ECONOMY' GROUP BY ALL ORDER BY y")
def yearly_trend(spark, d):
    return order_events(spark, d).where("category = 'ECONOMY'").groupBy(F.year(F.timestamp_seconds("ts")).alias("y"), "category").agg(F.count("*").alias("n")).orderBy("y")


@query("SELECT 'user' AS kind, count(DISTINCT user_id) AS n FROM ev UNION ALL SELECT 'item', count(DISTINCT item_id) FROM ev UNION ALL SELECT 'feature', count(DISTINCT brand) + count(DISTINCT category) FROM ev")
def dataset_cardinalities(spark, d):
    one = order_events(spark, d).agg(F.countDistinct("user_id").alias("user"), F.countDistinct("item_id").alias("item"), (F.countDistinct("brand") + F.countDistinct("category")).alias("feature"))
    return one.unpivot([], ["user", "item", "feature"], "kind", "n")


@query("SELECT item_id, round(count(*) / 6000.0, 4)::DOUBLE AS popularity FROM ev GROUP BY item_id HAVING round(count(*) / 6000.0, 4) > 0")
def popularity_feature(spark, d):
    n = order_events(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return n.select("item_id", F.round(F.col("n") / 6000.0, 4).alias("popularity")).where("popularity > 0")


@query("SELECT segment, age, count(*) AS users, round(avg(m), 6) AS mean_rating, round(avg(q) - avg(m) * avg(m), 6) AS variance FROM (SELECT user_id, avg(rating) AS m, avg(rating * rating) AS q FROM ev GROUP BY user_id) JOIN us USING (user_id) GROUP BY segment, age")
def segment_moments(spark, d):
    u = order_events(spark, d).groupBy("user_id").agg(F.avg("rating").alias("m"), F.avg(F.col("rating") * F.col("rating")).alias("q")).join(users(spark, d), "user_id")
    return u.groupBy("segment", "age").agg(F.count("*").alias("users"), F.round(F.avg("m"), 6).alias("mean_rating"), F.round(F.avg("q") - F.avg("m") * F.avg("m"), 6).alias("variance"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def activity_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def latest_activities(spark, d):
    e = g.ranked(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return e.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
