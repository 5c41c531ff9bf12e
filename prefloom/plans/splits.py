"""Splits, folds and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f, splits as s
from ..sources.tables import items, order_events, users
from .base import query

_HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
#: One rating of a user and item: the mean, so that repeated purchases count once.
_RATINGS = ", ra AS (SELECT user_id, item_id, avg(rating) AS rating FROM ev GROUP BY ALL)"
_USER_PART = f", up AS (SELECT user_id, CASE WHEN {_HASH.format('user_id')} % 10000 < 7500 THEN 1 ELSE 2 END AS part FROM us)"
_RATING_PART = f", rp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {_HASH.format(chr(39).join(['(user_id || ', '_', ' || item_id)']))}, item_id) <= floor(0.75 * count(*) OVER (PARTITION BY user_id)) THEN 1 ELSE 2 END AS part FROM ra)"
_ITEM_NO = ", itn AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_no FROM it)"


def ratings(spark, d):
    return order_events(spark, d).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def numbered_items(spark, d):
    from ..sources.sinks import dense_numbers

    return dense_numbers(items(spark, d).select("item_id"), "item_id", "n").select("item_id", (F.col("n") - 1).alias("item_no"))


@query(_USER_PART + " SELECT user_id, part FROM up")
def split_by_user_hash(spark, d):
    return s.split_users(users(spark, d))


@query(f", h AS (SELECT user_id, row_number() OVER (ORDER BY {_HASH.format('user_id')}, user_id) AS n FROM us) SELECT user_id, CASE WHEN n <= floor(0.75 * (SELECT count(*) FROM us)) THEN 1 ELSE 2 END AS part FROM h")
def split_by_user_exact(spark, d):
    return s.split_users(users(spark, d), exact=True)


@query(_RATINGS + _RATING_PART + " SELECT user_id, item_id, rating, part FROM rp")
def split_by_rating_hash(spark, d):
    return s.split_ratings(ratings(spark, d))


@query(_RATINGS + _USER_PART + _RATING_PART + " SELECT rp.user_id, item_id, rating, CASE WHEN up.part = 2 THEN 'cs' WHEN rp.part = 1 THEN 'train' ELSE 'test' END AS split FROM rp JOIN up USING (user_id)")
def train_test_cold_start(spark, d):
    return s.train_test_cold(ratings(spark, d)).select("user_id", "item_id", "rating", "split")


@query(_RATINGS + " SELECT user_id, item_id, ((row_number() OVER (ORDER BY user_id, item_id) - 1) % 5)::INT AS fold FROM ra")
def cv_folds(spark, d):
    return s.folds(ratings(spark, d)).select("user_id", "item_id", "fold")


@query(_RATINGS + _ITEM_NO + f""", w AS (SELECT user_id, count(*) AS n FROM ra GROUP BY ALL), dr AS (SELECT user_id, n, unnest(range(1, n * 4 + 1)) AS draw FROM w),
pk AS (SELECT user_id, n, {_HASH.format("(user_id || '_' || draw)")} % (SELECT count(*) FROM it) AS item_no, draw FROM dr), fp AS (SELECT user_id, n, item_no, min(draw) AS draw FROM pk GROUP BY ALL),
un AS (SELECT user_id, n, item_id, draw FROM fp JOIN itn USING (item_no) WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.user_id = fp.user_id AND ra.item_id = itn.item_id))
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY draw) AS rank FROM un QUALIFY rank <= n""")
def negative_samples_hash(spark, d):
    return s.negatives(ratings(spark, d), numbered_items(spark, d)).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(", p AS (SELECT DISTINCT user_id, ts, category FROM ev), c AS (SELECT DISTINCT category AS negative FROM ev) SELECT user_id, ts, category, negative, 0.05::DOUBLE AS weight FROM p, c WHERE negative <> category")
def negative_categories(spark, d):
    p = order_events(spark, d).select("user_id", "ts", "category").distinct()
    return s.other_categories(p, p.select("category").distinct())


@query(f", p AS (SELECT DISTINCT user_id, ts, category FROM ev), c AS (SELECT DISTINCT category AS negative FROM ev) SELECT user_id, ts, category, negative, 0.05::DOUBLE AS weight FROM p, c WHERE negative <> category QUALIFY row_number() OVER (PARTITION BY user_id, ts, category ORDER BY {_HASH.format(chr(39).join(['(user_id || ', '_', ' || ts || ', '_', ' || category || ', '_', ' || negative)']))}, negative) <= 2")
def negative_categories_random(spark, d):
    p = order_events(spark, d).select("user_id", "ts", "category").distinct()
    return s.other_categories(p, p.select("category").distinct(), 2)


@query(f", p AS (SELECT DISTINCT user_id, ts, category FROM ev), c AS (SELECT DISTINCT category AS negative FROM ev) SELECT user_id, ts, category, negative, 0.05::DOUBLE AS weight FROM p, c WHERE negative <> category QUALIFY row_number() OVER (PARTITION BY user_id, ts, category ORDER BY {_HASH.format(chr(39).join(['(user_id || ', '_', ' || ts || ', '_', ' || category || ', '_', ' || negative)']))}, negative) <= 20")
def negative_categories_random_20(spark, d):
    """20 other categories a purchase, all if there are fewer: the whole of negative_categories_random."""
    p = order_events(spark, d).select("user_id", "ts", "category").distinct()
    return s.other_categories(p, p.select("category").distinct(), 20)


@query(_RATINGS + _ITEM_NO + f""", dr AS (SELECT user_id, item_id AS for_item, unnest(range(1, 11)) AS draw FROM ra),
pk AS (SELECT user_id, for_item, {_HASH.format("(user_id || '_' || for_item || '_' || draw)")} % (SELECT count(*) FROM it) AS item_no FROM dr)
SELECT user_id, item_id, item_id AS for_item, 1 AS label FROM ra UNION ALL SELECT user_id, item_id, for_item, 0 FROM pk JOIN itn USING (item_no) WHERE item_id <> for_item""")
def labelled_pairs(spark, d):
    return f.labelled_pairs(ratings(spark, d), numbered_items(spark, d))


@query(", g AS (SELECT unnest(['male', 'female']) AS gender), a AS (SELECT unnest(range(0, 14)) AS age) SELECT 'test_user_' || gender || '_' || age AS id, 'gender_' || gender || ',age_' || age AS features FROM g, a")
def query_profiles(spark, d):
    g = spark.createDataFrame([("male",), ("female",)], "gender string")
    a = spark.range(14).select(F.col("id").cast("string").alias("age"))
    return g.crossJoin(a).select(F.concat_ws("_", F.lit("test_user"), "gender", "age").alias("id"), F.concat(F.lit("gender_"), "gender", F.lit(",age_"), "age").alias("features"))
