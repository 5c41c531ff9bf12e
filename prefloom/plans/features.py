"""Sparse features and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import features as f, popularity as op
from ..sources import sinks
from ..sources.checkpoints import stored
from ..sources.tables import items, order_events, users
from .base import query

_ITEM = """, fe AS (SELECT item_id, unnest([
  CASE WHEN brand IS NULL OR brand = '' THEN {'name': 'i_brand#miss', 'value': 1.0::DOUBLE} ELSE {'name': 'i_brand_' || lower(brand), 'value': 1.0} END,
  CASE WHEN category IS NULL OR category = '' THEN NULL ELSE {'name': 'i_category_' || lower(category), 'value': 1.0} END,
  CASE WHEN price IS NULL OR price = 0 THEN {'name': 'i_price#miss', 'value': 1.0} ELSE {'name': 'i_price', 'value': price} END,
  CASE WHEN ar IS NULL OR ar = 0 THEN {'name': 'i_ar#miss', 'value': 1.0} ELSE {'name': 'i_ar', 'value': ar} END], recursive := false) AS f
  FROM it LEFT JOIN (SELECT item_id, round(avg(rating) / 5, 6) AS ar FROM ev WHERE rating > 1 GROUP BY item_id) USING (item_id)), fl AS (SELECT item_id, f.name AS name, f.value AS value FROM fe WHERE f IS NOT NULL)"""
_DICT = ", di AS (SELECT name, row_number() OVER (ORDER BY name) AS fid FROM (SELECT DISTINCT name FROM fl))"
#: Rows of a dictionary that is broadcast.
FEW = 200_000
HANDLERS = {"brand": "categorical", "category": "categorical", "price": "numeric", "ar": "numeric"}


def item_features(spark, d):
    mean = order_events(spark, d).where("rating > 1").groupBy("item_id").agg(F.round(F.avg("rating") / 5, 6).alias("ar"))
    return f.entity_features(items(spark, d).join(mean, "item_id", "left"), "item_id", "i", HANDLERS, ["brand", "price", "ar"])


def dictionary(spark, names):
    return f.extend_dictionary(spark.createDataFrame([], "name string, fid long"), names)


@query(_ITEM + " SELECT item_id, name, value FROM fl")
def required_feature_miss(spark, d):
    return item_features(spark, d)


@query(_ITEM + _DICT + " SELECT name, fid FROM di")
def feature_index(spark, d):
    return dictionary(spark, item_features(spark, d))


@query(_ITEM + """, old AS (SELECT name, row_number() OVER (ORDER BY name) AS fid FROM (SELECT DISTINCT name FROM fl WHERE name LIKE 'i_brand%'))
SELECT name, fid FROM old UNION ALL SELECT name, (SELECT max(fid) FROM old) + row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT name FROM fl WHERE name NOT IN (SELECT name FROM old))""")
def feature_index_incremental(spark, d):
    all_ = item_features(spark, d)
    return f.extend_dictionary(dictionary(spark, all_.where("name like 'i_brand%'")), all_)


@query(_ITEM + _DICT + " SELECT item_id || ',' || string_agg(fid || ':' || value, ',' ORDER BY fid) AS value FROM fl JOIN di USING (name) WHERE name NOT LIKE 'i_price' AND name <> 'i_ar' GROUP BY item_id")
def sparse_feature_lines(spark, d):
    feats = item_features(spark, d)
    rows = f.indexed(feats.where("name <> 'i_price' and name <> 'i_ar'"), dictionary(spark, feats))
    return sinks.sparse_lines(rows.select(F.col("item_id").cast("string").alias("entity"), "fid", F.col("value").alias("fval")))


_USER = ", uf AS (SELECT user_id, 'u_segment_' || lower(segment) AS name, 1.0::DOUBLE AS value FROM us UNION ALL SELECT user_id, 'u_age_' || age, 0.5 FROM us), ud AS (SELECT name, row_number() OVER (ORDER BY name) AS fid FROM (SELECT DISTINCT name FROM uf))"


def user_features(spark, d):
    u = users(spark, d)
    one = F.struct(F.concat(F.lit("u_segment_"), F.lower("segment")).alias("name"), F.lit(1.0).alias("value"))
    two = F.struct(F.concat(F.lit("u_age_"), F.col("age").cast("string")).alias("name"), F.lit(0.5).alias("value"))
    return u.select("user_id", F.explode(F.array(one, two)).alias("f")).select("user_id", "f.*")


@query(_ITEM + _DICT + _USER + ", xi AS (SELECT item_id, fid, value FROM fl JOIN di USING (name) WHERE name LIKE 'i\\_b%' ESCAPE '\\' OR name LIKE 'i\\_c%' ESCAPE '\\'), xu AS (SELECT user_id, fid, value FROM uf JOIN ud USING (name)), pr AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT user_id, item_id, xu.fid || '|' || xi.fid AS name, xu.value * xi.value AS value FROM pr JOIN xu USING (user_id) JOIN xi USING (item_id)")
def user_item_interactions(spark, d):
    fi, fu = item_features(spark, d), user_features(spark, d)
    right = f.indexed(fi.where("name like 'i\\\\_b%' or name like 'i\\\\_c%'"), dictionary(spark, fi))
    left = f.indexed(fu, dictionary(spark, fu))
    return f.interactions(order_events(spark, d).select("user_id", "item_id").distinct(), left, right)


@query(_ITEM + _DICT + _USER + ", xi AS (SELECT item_id, fid, name FROM fl JOIN di USING (name) WHERE name LIKE 'i\\_b%' ESCAPE '\\'), xu AS (SELECT user_id, fid, name FROM uf JOIN ud USING (name) WHERE name LIKE 'u\\_s%' ESCAPE '\\'), pr AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT xu.fid || '|' || xi.fid AS name, xu.name AS left_name, xi.name AS right_name, count(*) AS n FROM pr JOIN xu USING (user_id) JOIN xi USING (item_id) GROUP BY ALL")
def interaction_names(spark, d):
    fi, fu = item_features(spark, d), user_features(spark, d)
    di, du = dictionary(spark, fi), dictionary(spark, fu)
    pairs = f.interactions(order_events(spark, d).select("user_id", "item_id").distinct(), f.indexed(fu.where("name like 'u\\\\_s%'"), du), f.indexed(fi.where("name like 'i\\\\_b%'"), di))
    return f.interaction_names(pairs.groupBy("name").agg(F.count("*").alias("n")), du, di).select("name", "left_name", "right_name", "n")


@query(_ITEM + _DICT + _USER + ", xi AS (SELECT item_id, fid, value FROM fl JOIN di USING (name)), xu AS (SELECT user_id, fid, value FROM uf JOIN ud USING (name)), pr AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT user_id, item_id, xu.fid || '|' || xi.fid AS name, xu.value * xi.value AS value FROM pr JOIN xu USING (user_id) JOIN xi USING (item_id)")
def user_item_interactions_all(spark, d):
    """Every user feature with every item feature: the whole of user_item_interactions."""
    fi, fu = item_features(spark, d), user_features(spark, d)
    return f.interactions(order_events(spark, d).select("user_id", "item_id").distinct(), f.indexed(fu, dictionary(spark, fu)), f.indexed(fi, dictionary(spark, fi)))


@query(_ITEM + _DICT + _USER + ", xi AS (SELECT item_id, fid, name FROM fl JOIN di USING (name)), xu AS (SELECT user_id, fid, name FROM uf JOIN ud USING (name)), pr AS (SELECT DISTINCT user_id, item_id FROM ev) SELECT xu.fid || '|' || xi.fid AS name, xu.name AS left_name, xi.name AS right_name, count(*) AS n FROM pr JOIN xu USING (user_id) JOIN xi USING (item_id) GROUP BY ALL")
def interaction_names_all(spark, d):
    """The whole of interaction_names."""
    fi, fu = item_features(spark, d), user_features(spark, d)
    di, du = dictionary(spark, fi), dictionary(spark, fu)
    pairs = f.interactions(order_events(spark, d).select("user_id", "item_id").distinct(), f.indexed(fu, du), f.indexed(fi, di))
    return f.interaction_names(pairs.groupBy("name").agg(F.count("*").alias("n")), du, di).select("name", "left_name", "right_name", "n")


@query(_ITEM + _DICT + ", q AS (SELECT user_id FROM us WHERE user_id % 50 = 0) SELECT user_id, it.item_id, coalesce(string_agg(fid::VARCHAR, ',' ORDER BY fid), '') AS fids FROM q CROSS JOIN it LEFT JOIN (SELECT item_id, fid FROM fl JOIN di USING (name)) x ON x.item_id = it.item_id GROUP BY user_id, it.item_id")
def prediction_rows(spark, d):
    feats = stored(item_features(spark, d), "item-features")
    known = dictionary(spark, feats)
    known = F.broadcast(known) if known.count() <= FEW else known
    fids = lambda features: F.array_join(F.transform(features, lambda v: v["fid"].cast("string")), ",")
    rows = f.prediction_rows(users(spark, d).where("user_id % 50 = 0"), items(spark, d), f.indexed(feats, known), fids)
    return rows.select("user_id", "item_id", F.col("features").alias("fids"))


@query(_ITEM + ", t AS (SELECT item_id FROM (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id ORDER BY n DESC, item_id LIMIT 50)) SELECT name, count(*) AS n FROM t JOIN fl USING (item_id) GROUP BY name")
def recommended_profile(spark, d):
    """Features of the fifty most popular items: a report of a top list."""
    top = order_events(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(50).select("item_id")
    return f.list_profile(top, item_features(spark, d))


@query(_USER + ", a AS (SELECT user_id, fid, value FROM uf JOIN ud USING (name) WHERE name LIKE 'u_seg%'), b AS (SELECT user_id, fid, value FROM uf JOIN ud USING (name) WHERE name LIKE 'u_age%') SELECT a.user_id, 'int_' || a.fid || '_' || b.fid AS name, a.value * b.value AS value FROM a JOIN b USING (user_id)")
def rule_interactions(spark, d):
    fu = user_features(spark, d)
    rows = f.indexed(fu, dictionary(spark, fu)).groupBy("user_id").agg(F.collect_list(F.struct("name", "fid", "value")).alias("features"))
    out = f.rule_interactions(rows, {"SEGMENT": "^u_segment", "AGE": "^u_age"}, ["SEGMENT", "AGE"])
    return out.select("user_id", F.explode("int").alias("x")).select("user_id", "x.name", "x.value")


@query(_ITEM + _DICT + " SELECT CASE WHEN name LIKE 'i_brand%' THEN 'BRAND' ELSE 'CATEGORY' END AS pattern, count(*) AS n, count(DISTINCT fid) AS features FROM fl JOIN di USING (name) WHERE name LIKE 'i_brand%' OR name LIKE 'i_category%' GROUP BY 1")
def classified_features(spark, d):
    feats = item_features(spark, d)
    dic = dictionary(spark, feats)
    rows = f.classified(f.indexed(feats, dic).drop("name"), dic, {"BRAND": "^i_brand", "CATEGORY": "^i_category"})
    return rows.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("fid").alias("features"))


@query(_ITEM + _DICT + " SELECT fid, name, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM fl JOIN di USING (name) WHERE name LIKE 'i_brand%' GROUP BY ALL")
def group_by_feature(spark, d):
    feats = item_features(spark, d)
    rows = f.indexed(feats, f.matching(dictionary(spark, feats), "^i_brand"))
    return rows.groupBy("fid", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda v: v.cast("string")), ",").alias("items"))


@query("SELECT category, row_number() OVER (ORDER BY category) AS label FROM (SELECT DISTINCT category FROM it)")
def category_class_label(spark, d):
    return f.category_labels(items(spark, d))


@query("SELECT DISTINCT category || '|' || brand AS category, unnest(['i_1c_' || category, 'i_2c_' || category || '|' || brand]) AS feature FROM it")
def category_prefixes(spark, d):
    c = items(spark, d).select(F.concat_ws("|", "category", "brand").alias("category")).distinct()
    return c.select("category", F.explode(x.category_prefixes(F.col("category"))).alias("feature"))


@query("SELECT c_custkey AS user_id, unnest(['i_c1_' || r_name, 'i_c-3_' || r_name, 'i_c2_' || n_name, 'i_c-2_' || n_name, 'i_c3_' || c_mktsegment, 'i_c-1_' || c_mktsegment]) AS feature FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def category_depth_feats(spark, d):
    from ..sources.tables import table

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("user_id"), F.explode(x.depth_features(F.array("r_name", "n_name"), F.col("c_mktsegment"))).alias("feature"))


_AGG = """, e AS (SELECT item_id, category, year(to_timestamp(ts) AT TIME ZONE 'UTC')::INT AS y FROM ev),
ip AS (SELECT item_id, count(*) AS n FROM e GROUP BY ALL), ipy AS (SELECT item_id, y, count(*) AS n FROM e GROUP BY ALL), cp AS (SELECT category, count(*) AS n FROM e GROUP BY ALL), cpy AS (SELECT category, y, count(*) AS n FROM e GROUP BY ALL)
SELECT item_id, name, value FROM (
SELECT item_id, 'i_ip' AS name, round(n::DOUBLE / (SELECT max(n) FROM ip), 3) AS value FROM ip
UNION ALL SELECT item_id, 'i_ipy_' || y, round(n::DOUBLE / max(n) OVER (PARTITION BY y), 3) FROM ipy
UNION ALL SELECT item_id, 'i_cp_' || category, round(cp.n::DOUBLE / (SELECT max(n) FROM cp), 3) FROM it JOIN cp USING (category)
UNION ALL SELECT item_id, 'i_cpy_' || category || '_' || y, round(c.v, 3) FROM it JOIN (SELECT category, y, n::DOUBLE / max(n) OVER (PARTITION BY y) AS v FROM cpy) c USING (category)
UNION ALL SELECT item_id, 'i_cip_' || category, round(ip.n::DOUBLE / cp.n, 3) FROM ip JOIN it USING (item_id) JOIN cp USING (category)
UNION ALL SELECT item_id, 'i_cipy_' || it.category || '_' || ipy.y, round(ipy.n::DOUBLE / cpy.n, 3) FROM ipy JOIN it USING (item_id) JOIN cpy ON cpy.category = it.category AND cpy.y = ipy.y
UNION ALL SELECT item_id, 'i_ip#miss', 1.0 FROM it WHERE item_id NOT IN (SELECT item_id FROM ip)) WHERE value > 0"""


@query(_AGG)
def item_agg_features(spark, d):
    """Popularity features of an item and its category, in all and by year; zeros after rounding are left out."""
    e = order_events(spark, d).select("item_id", "category", F.year(F.timestamp_seconds("ts")).alias("y"))
    it = items(spark, d).select("item_id", "category")
    n = F.count("*").alias("n")
    ip, ipy, cp, cpy = e.groupBy("item_id").agg(n), e.groupBy("item_id", "y").agg(n), e.groupBy("category").agg(n), e.groupBy("category", "y").agg(n)
    cn = lambda df: df.withColumnRenamed("n", "cn")
    ratio = F.round(F.col("n") / F.col("cn"), 3).alias("value")
    name = lambda *parts: F.concat_ws("_", *parts).alias("name")
    out = op.over_max(ip, "n", "value", digits=3).select("item_id", F.lit("i_ip").alias("name"), "value")
    out = out.unionByName(op.over_max(ipy, "n", "value", ["y"], 3).select("item_id", name(F.lit("i_ipy"), "y"), "value"))
    out = out.unionByName(it.join(op.over_max(cp, "n", "value", digits=3), "category").select("item_id", name(F.lit("i_cp"), "category"), "value"))
    out = out.unionByName(it.join(op.over_max(cpy, "n", "value", ["y"], 3), "category").select("item_id", name(F.lit("i_cpy"), "category", "y"), "value"))
    out = out.unionByName(ip.join(it, "item_id").join(cn(cp), "category").select("item_id", name(F.lit("i_cip"), "category"), ratio))
    out = out.unionByName(ipy.join(it, "item_id").join(cn(cpy), ["category", "y"]).select("item_id", name(F.lit("i_cipy"), "category", "y"), ratio))
    out = out.unionByName(it.join(ip, "item_id", "left_anti").select("item_id", F.lit("i_ip#miss").alias("name"), F.lit(1.0).alias("value")))
    return out.where("value > 0")


@query(_ITEM + _DICT + " SELECT (CASE WHEN item_id % 2 = 0 THEN '1' ELSE '0' END) || ' ' || string_agg(fid || ':1.0', ' ' ORDER BY fid) AS value FROM fl JOIN di USING (name) WHERE name LIKE 'i_brand%' OR name LIKE 'i_category%' GROUP BY item_id")
def libsvm_samples(spark, d):
    feats = item_features(spark, d)
    rows = f.indexed(feats.where("name like 'i_brand%' or name like 'i_category%'"), dictionary(spark, feats))
    samples = rows.groupBy("item_id").agg(F.collect_list(F.struct("fid", F.col("value").alias("fval"))).alias("features")).withColumn("label", F.when(F.col("item_id") % 2 == 0, 1).otherwise(0))
    return sinks.libsvm_lines(samples)


@query(_ITEM + _DICT + ", ks AS (SELECT DISTINCT item_id FROM fl WHERE name LIKE 'i_brand%'), nr AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS row FROM ks) SELECT row, fid AS col, value AS val FROM fl JOIN di USING (name) JOIN nr USING (item_id) WHERE name LIKE 'i_brand%'")
def sparse_coordinates(spark, d):
    feats = item_features(spark, d)
    rows = f.indexed(feats.where("name like 'i_brand%'"), dictionary(spark, feats))
    samples = rows.groupBy("item_id").agg(F.collect_list(F.struct("fid", F.col("value").alias("fval"))).alias("features"))
    return sinks.coordinates(samples, "item_id").select(F.col("row"), F.col("col"), F.col("val"))


@query("SELECT item_id, 2 || '_' || item_id AS key, 2::TINYINT AS type, item_id::VARCHAR AS name, md5(name) AS digest, CAST(floor(size / 5.0) AS INTEGER) AS bucket FROM it")
def keys_and_buckets(spark, d):
    it = items(spark, d)
    key = x.composite_key(F.lit(2), F.col("item_id").cast("string"))
    kind, name = x.split_key(key)
    return it.select("item_id", key.alias("key"), kind.alias("type"), name.alias("name"), F.md5(F.col("name").cast("binary")).alias("digest"), x.age_bucket(F.col("size")).alias("bucket"))
