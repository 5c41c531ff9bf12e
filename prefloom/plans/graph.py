"""Entities, edges, lookups and recommendations as the graph store serves them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources import sinks
from ..sources.schema import RATE_ITEM
from ..sources.tables import items, order_events, table, users
from .base import query

ORDER = ["ts", "order_id", "value", "price"]


def rating_edges(spark, d):
    """User to item edges; items' ids come after users' in the one id space."""
    e = order_events(spark, d)
    return e.select(F.col("user_id").alias("from_id"), (F.col("item_id") + 1_000_000_000).alias("to_id"), F.lit(RATE_ITEM).alias("type"), F.col("rating").cast("double").alias("value"), "ts", "order_id", "price")


def entities(spark, d):
    u = users(spark, d).select(F.col("user_id").alias("entity_id"), F.lit(1).alias("type"), "name", F.col("segment").alias("desc"))
    return u.unionByName(items(spark, d).select((F.col("item_id") + 1_000_000_000).alias("entity_id"), F.lit(2).alias("type"), F.col("item_id").cast("string").alias("name"), F.col("name").alias("desc")))


_EDGES = ", ed AS (SELECT user_id AS from_id, item_id + 1000000000 AS to_id, 8 AS type, rating::DOUBLE AS value, ts, order_id, price FROM ev), fe AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id) ORDER BY ts, order_id, value, price) = 1)"
_ENT = ", en AS (SELECT user_id AS entity_id, 1 AS type, name, segment AS \"desc\" FROM us UNION ALL SELECT item_id + 1000000000, 2, item_id::VARCHAR, name FROM it)"


@query(_EDGES + " SELECT from_id, to_id, type, value, ts FROM fe")
def edge_dedupe_first(spark, d):
    return g.first_edges(rating_edges(spark, d), ORDER).select("from_id", "to_id", "type", "value", "ts")


@query(_EDGES + ", bw AS (SELECT from_id AS ent, to_id AS other, type, value FROM fe UNION ALL SELECT to_id, from_id, type, value FROM fe) SELECT ent, type, count(*) AS n, string_agg(other::VARCHAR || ':' || value::INT::VARCHAR, ',' ORDER BY other) AS interacts FROM bw GROUP BY ALL")
def adjacency_lists(spark, d):
    a = g.adjacency(g.first_edges(rating_edges(spark, d), ORDER))
    text = F.array_join(F.transform("interacts", lambda x: F.concat_ws(":", x["other"].cast("string"), x["value"].cast("int").cast("string"))), ",")
    return a.select("ent", "type", F.size("interacts").cast("long").alias("n"), text.alias("interacts"))


@query(_ENT + " SELECT e.user_id, e.item_id, coalesce(en.name, '') AS name FROM (SELECT DISTINCT user_id, item_id, item_id + 1000000000 AS k FROM ev) e LEFT JOIN en ON en.entity_id = e.k")
def resolve_names(spark, d):
    e = order_events(spark, d).select("user_id", "item_id", (F.col("item_id") + 1_000_000_000).alias("k")).distinct()
    return g.names(e, entities(spark, d), "k").select("user_id", "item_id", "name")


@query(_ENT + ", w AS (SELECT 1 AS type, c_name AS name FROM customer UNION ALL SELECT 1, 'nobody') SELECT w.type, w.name, coalesce(entity_id, -1) AS entity_id FROM w LEFT JOIN en ON en.type = w.type AND en.name = w.name")
def resolve_ids(spark, d):
    w = users(spark, d).select(F.lit(1).alias("type"), "name").unionByName(spark.createDataFrame([(1, "nobody")], "type int, name string"))
    return g.ids(w, entities(spark, d)).select("type", "name", "entity_id")


@query(_ENT + ", cur AS (SELECT * FROM en WHERE entity_id % 2 = 0), mi AS (SELECT * FROM en WHERE entity_id % 2 = 1) SELECT entity_id, type, name, \"desc\" FROM cur UNION ALL SELECT (SELECT max(entity_id) FROM cur) + row_number() OVER (ORDER BY type, name), type, name, \"desc\" FROM mi")
def entity_upsert(spark, d):
    e = entities(spark, d)
    return g.upsert_entities(e.where("entity_id % 2 = 0"), e.select("type", "name", "desc"))


@query(_EDGES + " SELECT from_id, to_id, value FROM ed WHERE from_id IN (SELECT user_id FROM us WHERE segment = 'MACHINERY') AND to_id IN (SELECT item_id + 1000000000 FROM it WHERE category = 'PROMO')")
def edges_within(spark, d):
    u = users(spark, d).where("segment = 'MACHINERY'").select(F.col("user_id").alias("entity_id"))
    i = items(spark, d).where("category = 'PROMO'").select((F.col("item_id") + 1_000_000_000).alias("entity_id"))
    return g.within(rating_edges(spark, d), u.unionByName(i)).select("from_id", "to_id", "value")


@query(_EDGES + " SELECT from_id, to_id, value FROM ed WHERE value = 0 OR value IS NULL")
def zero_value_edges(spark, d):
    return g.zero_edges(rating_edges(spark, d)).select("from_id", "to_id", "value")


@query("SELECT order_id AS rating_id, max_by(user_id, ts) AS user_id, max_by(item_id, quantity * 1e9 + item_id) AS item_id FROM ev GROUP BY order_id")
def rating_node_links(spark, d):
    e = order_events(spark, d)
    u = g.last_link(e.select(F.col("order_id").alias("rating_id"), "user_id", F.lit(None).cast("long").alias("item_id"), "ts"), "ts").drop("item_id")
    i = g.last_link(e.select(F.col("order_id").alias("rating_id"), F.lit(None).cast("long").alias("user_id"), "item_id", (F.col("quantity") * 1e9 + F.col("item_id")).alias("o")), "o").drop("user_id")
    return u.join(i, "rating_id")


@query("SELECT c_custkey + 100 + 1000000 AS node, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey + 100, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_name FROM region")
def category_paths(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_100).alias("node"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).cast("long").alias("parent"))
    return g.ancestors(r.unionByName(n).unionByName(c))


@query("SELECT category, min_by(name, price * 1e6 + item_id) AS name FROM it GROUP BY category")
def first_names(spark, d):
    return g.first_name(items(spark, d), "category", "name", ["price", "item_id"])


@query("SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def category_parents(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("n_name", "r_name").alias("nodes"))
    return g.parents(c.select(F.array("c_mktsegment", "n_name", "r_name").alias("nodes")).unionByName(nations))


@query("""SELECT o.user_id, '{"userId":"' || o.user_id || '","features":["' || segment || '"],"featureNames":["segment_' || segment || '"],"recIdList":[' || ids || '],"recNameList":[' || names || ']}' AS value
FROM (SELECT user_id, segment FROM us) o, (SELECT string_agg('"' || item_id || '"', ',' ORDER BY n DESC, item_id) AS ids, string_agg('"' || name || '"', ',' ORDER BY n DESC, item_id) AS names FROM (SELECT item_id, count(*) AS n FROM ev GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20) JOIN it USING (item_id))""")
def rec_json(spark, d):
    top = order_events(spark, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(20).join(items(spark, d).select("item_id", F.col("name").alias("item_name")), "item_id")
    best = top.withColumn("rank", F.struct((-F.col("n")).alias("n"), "item_id"))
    u = users(spark, d).select("user_id", F.array("segment").alias("features"), F.array(F.concat(F.lit("segment_"), "segment")).alias("feature_names"))
    return sinks.recommendation_json(u.crossJoin(F.broadcast(best)))


@query("""SELECT user_id, '{"i":[' || string_agg('{"i":"' || item_id || '","s":' || n || '.0}', ',' ORDER BY n DESC, item_id) || ']}' AS value
FROM (SELECT * FROM (SELECT user_id, item_id, count(*) AS n FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) <= 10) GROUP BY user_id""")
def stored_rec_lists(spark, d):
    n = order_events(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("score"))
    return sinks.stored_list(g.ranked(n, ["user_id"], [F.desc("score"), "item_id"], 10))


@query(_EDGES + " SELECT from_id, to_id, value - 3 AS value FROM ed WHERE value = 3")
def zero_centred_edges(spark, d):
    """Edges of value 0 once ratings are counted from the middle of the scale."""
    return g.zero_edges(rating_edges(spark, d).withColumn("value", F.col("value") - 3)).select("from_id", "to_id", "value")


@query(_EDGES + _ENT + " SELECT 'node' || chr(9) || type || chr(9) || entity_id || chr(9) || name AS value FROM en UNION ALL SELECT 'edge' || chr(9) || type || chr(9) || from_id || chr(9) || to_id || chr(9) || value FROM fe")
def graph_dump(spark, d):
    return g.dump(entities(spark, d), g.first_edges(rating_edges(spark, d), ORDER))


_LISTS = ", rl AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_id) AS rank FROM (SELECT user_id, item_id, count(*) AS n FROM ev GROUP BY ALL) QUALIFY rank <= 10), md AS (SELECT user_id, rank, item_id, name, 1950 + size AS year, string_split(name, ' ') AS genres FROM rl JOIN it USING (item_id))"


def _listed(spark, d):
    """Each user's ten items bought most often with the items' name, year and genres."""
    n = order_events(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("score"))
    best = g.ranked(n, ["user_id"], [F.desc("score"), "item_id"], 10).drop("score")
    it = items(spark, d).select("item_id", "name", (1950 + F.col("size")).alias("year"), F.split("name", " ").alias("genres"))
    return g.with_metadata(best, it, ["name", "year", "genres"])


@query(_LISTS + " SELECT user_id, rank, item_id, name, year, array_to_string(genres, '|') AS genres FROM md")
def rec_list_metadata(spark, d):
    return _listed(spark, d).select("user_id", "rank", "item_id", "name", "year", F.array_join("genres", "|").alias("genres"))


@query(_LISTS + " SELECT 'year' AS kind, year::VARCHAR AS value, count(*) AS n FROM md GROUP BY year UNION ALL SELECT 'genres', g, count(*) FROM (SELECT unnest(genres) AS g FROM md) GROUP BY g")
def rec_list_histograms(spark, d):
    return g.histograms(_listed(spark, d), ["year", "genres"])


@query(_LISTS + """ SELECT user_id, '{"userId":"' || user_id || '","features":["' || any_value(segment) || '"],"recIdList":[' || string_agg('"' || item_id || '"', ',' ORDER BY rank) || ']}' AS value FROM rl JOIN us USING (user_id) GROUP BY user_id""")
def rec_json_ids(spark, d):
    u = users(spark, d).select("user_id", F.array("segment").alias("features"))
    return sinks.recommendation_json(_listed(spark, d).join(u, "user_id"), names=False)


@query(" SELECT category, n FROM (SELECT category, count(*) AS n FROM ev GROUP BY category) QUALIFY row_number() OVER (ORDER BY n DESC, category) <= 3")
def top_categories(spark, d):
    """The three categories bought most often: a report of n."""
    return order_events(spark, d).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(3)


@query(" SELECT row_number() OVER (ORDER BY item_id) AS row, (category = 'PROMO')::INT AS label FROM it WHERE size % 2 = 0")
def coordinate_labels(spark, d):
    """Labels of the rows that have features, by the numbers of their coordinates."""
    features = F.when(F.col("size") % 2 == 0, F.array(F.struct(F.lit(1).alias("fid"), F.lit(1.0).alias("fval")))).otherwise(F.array().cast("array<struct<fid:int,fval:double>>"))
    samples = items(spark, d).select("item_id", features.alias("features"), (F.col("category") == "PROMO").cast("int").alias("label"))
    return sinks.coordinate_labels(samples, "item_id")
