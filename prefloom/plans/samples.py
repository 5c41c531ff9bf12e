"""Ranking samples, merges, conversions, encoders, and files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as x
from ..operators import features as f, popularity as op, samples as s, splits as sp
from ..sources import readers, sinks
from ..sources.checkpoints import shared_path
from ..sources.tables import items, order_events, order_pairs, users
from .base import query
from .features import _DICT, _ITEM, _USER, dictionary, item_features, user_features
from .splits import _HASH, _RATINGS, ratings

_LABELS = ", la AS (SELECT category, row_number() OVER (ORDER BY category) AS label FROM (SELECT DISTINCT category FROM ev))"


def _hash(*parts: str) -> str:
    return _HASH.format("(" + " || '_' || ".join(parts) + ")")


def _names(features: str, prefix: str):
    return F.array_join(F.transform(F.filter(features, lambda e: F.startswith(e["name"], F.lit(prefix))), lambda e: e["name"]), ",")


def _total(features: str):
    return F.aggregate(features, F.lit(0.0), lambda a, e: a + e["value"])


def category_popularity(spark, d) -> DataFrame:
    return op.over_max(order_events(spark, d).groupBy("category").agg(F.count("*").alias("n")), "n", "value").select("category", "value")


@query(""", b AS (SELECT DISTINCT user_id, ts AS now, category FROM ev), tm AS (SELECT DISTINCT user_id, now FROM b), cn AS (SELECT category, count(*) AS n FROM ev GROUP BY category), cp AS (SELECT category, round(n::DOUBLE / (SELECT max(n) FROM cn), 6) AS value FROM cn),
m AS (SELECT user_id, ts, category, count(*) AS n FROM ev GROUP BY ALL), pa AS (SELECT tm.user_id, tm.now, m.category AS past, sum(n) AS n FROM tm JOIN m ON m.user_id = tm.user_id AND m.ts < tm.now GROUP BY ALL),
g AS (SELECT pa.user_id, pa.now, cp.category, count(*) AS k, sum(n) AS total, string_agg('ci_' || past || '|' || cp.category, ',' ORDER BY past) AS names FROM pa, cp GROUP BY ALL)
SELECT tm.user_id, tm.now, cp.category, (b.category IS NOT NULL)::INT AS label, CASE WHEN b.category IS NULL THEN 0.05 ELSE 1 END::DOUBLE AS weight, (1 + coalesce(k, 0))::INT AS n_features, round(value + coalesce(total, 0), 6) AS total, coalesce(names, '') AS names
FROM tm CROSS JOIN cp LEFT JOIN b ON b.user_id = tm.user_id AND b.now = tm.now AND b.category = cp.category LEFT JOIN g ON g.user_id = tm.user_id AND g.now = tm.now AND g.category = cp.category""")
def purchase_samples(spark, d):
    out = s.purchase_samples(order_events(spark, d), category_popularity(spark, d))
    return out.select("user_id", "now", "category", "label", "weight", F.size("features").alias("n_features"), F.round(_total("features"), 6).alias("total"), _names("features", "ci_").alias("names"))


@query(_LABELS + """, b AS (SELECT DISTINCT user_id, ts AS now, category FROM ev), m AS (SELECT user_id, ts, category, count(*) AS n FROM ev GROUP BY ALL),
pa AS (SELECT b.user_id, b.now, b.category, m.category AS past, sum(n) AS n FROM b JOIN m ON m.user_id = b.user_id AND m.ts < b.now GROUP BY ALL),
g AS (SELECT user_id, now, category, string_agg('hc_' || past || ':' || n::BIGINT, ',' ORDER BY past) AS features FROM pa GROUP BY ALL)
SELECT b.user_id, b.now, label, coalesce(features, '') AS features FROM b JOIN la USING (category) LEFT JOIN g ON g.user_id = b.user_id AND g.now = b.now AND g.category = b.category""")
def class_samples(spark, d):
    e = order_events(spark, d)
    out = s.class_samples(e, f.category_labels(e))
    whole = F.transform("features", lambda v: F.struct(v["name"].alias("name"), v["value"].cast("long").alias("value")))
    return out.withColumn("features", whole).select("user_id", "now", "label", s.feature_line("features").alias("features"))


@query(_RATINGS + _ITEM + _USER + """, u AS (SELECT user_id, count(*) AS n, sum(value) AS s FROM uf GROUP BY ALL), i AS (SELECT item_id, count(*) AS n, sum(value) AS s FROM fl GROUP BY ALL)
SELECT user_id, item_id, (rating <> 0)::INT AS label, (coalesce(u.n, 0) + coalesce(i.n, 0) + coalesce(u.n * i.n, 0))::INT AS n_features, round(coalesce(u.s, 0) + coalesce(i.s, 0) + coalesce(u.s * i.s, 0), 3) AS total FROM ra LEFT JOIN u USING (user_id) LEFT JOIN i USING (item_id)""")
def rating_samples(spark, d):
    out = s.rating_samples(ratings(spark, d), user_features(spark, d).select("user_id", "name", "value"), item_features(spark, d))
    return out.select("user_id", "item_id", "label", F.size("features").alias("n_features"), F.round(_total("features"), 3).alias("total"))


@query(f""", itc AS (SELECT item_id, category, row_number() OVER (ORDER BY category, item_id) - 1 AS item_no FROM it), rg AS (SELECT category, min(item_no) AS first, count(*) AS own FROM itc GROUP BY category),
p AS (SELECT DISTINCT user_id, ts, category FROM ev), dr AS (SELECT p.*, first, own, (SELECT count(*) FROM it) AS total, unnest(range(1, 6))::INT AS draw FROM p JOIN rg USING (category)),
pk AS (SELECT *, {_hash('user_id', 'ts', 'category', 'draw')} % (total - own) AS spot FROM dr WHERE total > own)
SELECT user_id, ts, pk.category, draw, itc.item_id FROM pk JOIN itc ON itc.item_no = CASE WHEN spot < first THEN spot ELSE spot + own END""")
def other_category_negatives(spark, d):
    numbered = sinks.dense_numbers(items(spark, d).select("item_id", "category").withColumn("_k", F.struct("category", "item_id")), "_k", "n").select("item_id", "category", (F.col("n") - 1).alias("item_no"))
    return s.other_category_items(order_events(spark, d).select("user_id", "ts", "category").distinct(), numbered)


@query(" SELECT us.user_id, it.item_id FROM us, it WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = us.user_id AND ev.item_id = it.item_id)")
def user_unseen_items(spark, d):
    return s.unseen_items(users(spark, d).select("user_id"), order_pairs(spark, d), items(spark, d))


@query(_USER + """, al AS (SELECT user_id, name, value FROM uf UNION ALL SELECT user_id, 'u_lines', count(*)::DOUBLE FROM ev GROUP BY user_id)
SELECT user_id, string_agg(name || ':' || value, ',' ORDER BY name, value) AS features FROM al GROUP BY user_id""")
def merged_user_features(spark, d):
    lines = order_events(spark, d).groupBy("user_id").agg(F.count("*").cast("double").alias("value")).select("user_id", F.lit("u_lines").alias("name"), "value")
    out = s.merged_features([user_features(spark, d).select("user_id", "name", "value"), lines], "user_id")
    return out.select("user_id", s.feature_line("features").alias("features"))


@query(_ITEM + " SELECT name, value, count(*) AS n FROM fl GROUP BY ALL")
def feature_value_distribution(spark, d):
    return s.value_distribution(item_features(spark, d))


@query(", se AS (SELECT DISTINCT user_id, item_id FROM ev), p AS (SELECT a.item_id, b.item_id AS other, count(*) AS users FROM se a JOIN se b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY ALL) SELECT users, count(*) AS pairs FROM p GROUP BY users")
def cooccurrence_histogram(spark, d):
    seen = order_events(spark, d).select("user_id", "item_id").distinct()
    pairs = seen.join(seen.withColumnRenamed("item_id", "other"), "user_id").where("item_id < other").groupBy("item_id", "other").agg(F.count("*").alias("users"))
    return pairs.groupBy("users").agg(F.count("*").alias("pairs"))


@query(", u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS row FROM us), i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS row FROM it) SELECT row, user_id, item_id FROM u JOIN i USING (row)")
def joined_by_position(spark, d):
    return s.by_position(users(spark, d).select("user_id"), items(spark, d).select("item_id"), "user_id", "item_id").select("row", "user_id", "item_id")


@query(_RATINGS + f", h AS (SELECT user_id, item_id, rating, row_number() OVER (ORDER BY {_hash('user_id', 'item_id')}, user_id, item_id) AS n FROM ra) SELECT user_id, item_id, rating FROM h WHERE n <= floor(0.2 * (SELECT count(*) FROM ra))")
def fifth_of_ratings(spark, d):
    return s.share_of_rows(ratings(spark, d), ["user_id", "item_id"], 0.2).select("user_id", "item_id", "rating")


@query(f", h AS (SELECT user_id, row_number() OVER (ORDER BY {_HASH.format('user_id')}, user_id) AS n FROM us) SELECT user_id, CASE WHEN n <= floor(0.8 * (SELECT count(*) FROM us)) + 1 THEN 1 ELSE 2 END AS part FROM h")
def split_by_user_four_fifths(spark, d):
    return sp.split_users(users(spark, d), 0.8, exact=True, plus=1)


@query(" SELECT DISTINCT item_id AS from_id, user_id AS to_id FROM ev a WHERE rating <= 2 AND EXISTS (SELECT 1 FROM ev b WHERE rating = 5 AND ((b.user_id = a.user_id AND b.item_id = a.item_id) OR (b.user_id = a.item_id AND b.item_id = a.user_id)))")
def existing_edges(spark, d):
    e = order_events(spark, d)
    wanted = e.where("rating <= 2").select(F.col("item_id").alias("from_id"), F.col("user_id").alias("to_id")).distinct()
    return s.existing_edges(wanted, e.where("rating = 5").select(F.col("user_id").alias("from_id"), F.col("item_id").alias("to_id")))


@query(" SELECT user_id, item_id, order_id, category FROM ev WHERE starts_with(category, 'P')")
def orders_with_prefix(spark, d):
    return order_events(spark, d).where(F.startswith("category", F.lit("P"))).select("user_id", "item_id", "order_id", "category")


@query(""" SELECT '{"user_id":"' || user_id || '"}' AS value FROM us""")
def user_id_json(spark, d):
    return s.json_rows(users(spark, d), ["user_id"])


@query(" SELECT user_id || ',' || name || ',' || segment AS value FROM us")
def user_csv(spark, d):
    return s.csv_rows(users(spark, d), ["user_id", "name", "segment"])


@query(""", t AS (SELECT *, (item_id % 7)::VARCHAR AS k, size::VARCHAR AS s FROM it)
SELECT item_id, replace(brand || name, ',', '') AS no_commas, category || '&' || brand AS ampersand, category || '|' || brand AS top_levels, CASE WHEN s = k THEN s ELSE s || ',' || k END AS node_ids, s || '-' || brand AS first_nodes,
(size // 5)::INT AS age_range, brand AS believed, size / 100.0::DOUBLE AS belief, CASE WHEN item_id % 2 = 0 THEN -1 ELSE 1 END::DOUBLE AS sign, (size + 50)::INT AS year_offset, (1950 + size)::INT AS title_year, brand AS merchant, lower(brand) AS attribute_k, s AS attribute_z,
strftime(to_timestamp(size * 100000 + 5) AT TIME ZONE 'UTC', '%Y-%-m-%-d %-H:%-M:%-S') AS loose, CASE WHEN item_id % 3 = 0 THEN 'tfidf' WHEN item_id % 3 = 1 THEN 'tf' ELSE name END AS handler FROM t""")
def text_scalars(spark, d):
    t = items(spark, d)
    c = lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p).cast("string") for p in parts])
    node = F.concat(c("size", "'-", "brand", "'/"), (F.col("item_id") % 7).cast("string"), c("'-", "category", "'|", "size", "'-", "brand"))
    year = (1950 + F.col("size")).cast("string")
    value, share = x.with_confidence(c("brand", "'_", "size"))
    attributes = x.attribute_map(c("'K: ", "brand", "'|Z:0|none|z:", "size"))
    feature = F.concat(F.when(F.col("item_id") % 3 == 0, "x_tfidf_").when(F.col("item_id") % 3 == 1, "x_tf_").otherwise(""), "name")
    return t.select(
        "item_id", x.strip_commas(c("brand", "',", "name")).alias("no_commas"), x.join_ampersands(c("category", "' & ", "brand")).alias("ampersand"), x.top_levels(c("category", "'|", "brand", "'|", "size"), 2).alias("top_levels"),
        F.array_join(x.node_ids(x.category_nodes(node)), ",").alias("node_ids"), F.array_join(x.category_nodes(node, 1), ",").alias("first_nodes"), x.age_range_bucket(F.concat(c("size", "'_"), (F.col("size") + 9).cast("string"))).alias("age_range"),
        value.alias("believed"), share.alias("belief"), x.gender_sign(F.when(F.col("item_id") % 2 == 0, "Female").otherwise("male")).alias("sign"), x.year_offset(F.concat(year, F.lit("-3-7"))).alias("year_offset"), x.title_year(F.concat("name", F.lit(" ("), year, F.lit(")"))).alias("title_year"),
        x.merchant_name(c("brand", "',", "item_id")).alias("merchant"), attributes["k"].alias("attribute_k"), attributes["z"].alias("attribute_z"), x.loose_datetime(F.col("size") * 100000 + 5).alias("loose"), x.handler_group(feature).alias("handler"),
    )


@query(""" SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(string_split(name, ' '), lambda w: 'genre_' || lower(w)))), ',') AS genres,
CASE WHEN item_id % 2 = 0 THEN 'i_author_' || lower(name) ELSE array_to_string(list_sort(list_distinct(['i_author_' || lower(brand), 'i_author_' || lower(category)])), ',') END AS authors, 'm_' || lower(brand) AS merchant FROM it""")
def list_encoders(spark, d):
    authors = F.when(F.col("item_id") % 2 == 0, F.col("name")).otherwise(F.to_json(F.array("brand", "category")))
    line = lambda a: F.array_join(F.array_sort(a), ",")
    return items(spark, d).select("item_id", line(x.each_value("genre", F.split("name", " "))).alias("genres"), line(x.author_features(authors)).alias("authors"), x.merchant_feature(F.concat("brand", F.lit(","), F.col("item_id").cast("string"))).alias("merchant"))


@query(""" SELECT user_id, 'gender:' || CASE WHEN user_id % 2 = 0 THEN '-1.0' ELSE '1.0' END || CASE WHEN age IS NULL OR age = 0 THEN '' ELSE ',u_age_' || age || ':1.0' END || ',u_segment_' || lower(segment) || ':1.0' AS features FROM us""")
def user_encoders(spark, d):
    made = x.movie_user_features(F.when(F.col("user_id") % 2 == 0, "female").otherwise("male"), {"age": F.col("age"), "segment": F.col("segment")})
    return users(spark, d).select("user_id", made.alias("features")).select("user_id", s.feature_line("features").alias("features"))


@query(_RATINGS + " SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, rating FROM ra")
def ratings_by_file(spark, d):
    """Written as tab-separated text of three columns and read back."""
    path = shared_path(spark, "ratings-tsv")
    sinks.write_tsv(ratings(spark, d), path)
    return readers.ratings_tsv(spark, path).select("user_id", "item_id", "rating")


@query(_RATINGS + " SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, rating FROM ra")
def ratings_by_json(spark, d):
    path = shared_path(spark, "ratings-json")
    s.json_rows(ratings(spark, d).toDF("u", "i", "r")).write.text(path)
    return readers.json_ratings(spark, path).select("user_id", "item_id", "rating")


@query(_ITEM + _DICT + " SELECT item_id::VARCHAR AS entity, fid, value AS fval FROM fl JOIN di USING (name)")
def features_by_file(spark, d):
    path, feats = shared_path(spark, "features"), item_features(spark, d)
    rows = f.indexed(feats, dictionary(spark, feats))
    sinks.sparse_lines(rows.select(F.col("item_id").cast("string").alias("entity"), "fid", F.col("value").alias("fval"))).write.text(path)
    return readers.sparse_rows(spark, path)


@query(", i AS (SELECT item_id || ' ' || brand AS value, row_number() OVER (ORDER BY item_id) AS row FROM it) SELECT row, value FROM i WHERE row % 50 = 1")
def lines_at_positions(spark, d):
    """Every fiftieth line of a file, by a file of positions."""
    path, index = shared_path(spark, "lines"), shared_path(spark, "index")
    items(spark, d).orderBy("item_id").select(F.concat_ws(" ", "item_id", "brand").alias("value")).write.text(path)
    n = items(spark, d).count()
    spark.range(1, n + 1, 50).select(F.col("id").cast("string").alias("value")).write.text(index)
    return readers.rows_at(spark, path, index)
