"""Ordered histories and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..sources.tables import order_events
from .base import query

ORDER = ["ts", "order_id", "item_id", "quantity", "price"]
_ORDER = ", ".join(ORDER)
CUTS = [852076800, 946684800]  # 1997-01-01 and 2000-01-01
_PAIRS = ", m AS (SELECT user_id, ts, category, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT a.user_id, a.ts AS now, a.category AS cur, a.n AS cur_n, b.ts AS t0, b.category AS past, b.n AS past_n FROM m a JOIN m b ON a.user_id = b.user_id AND b.ts < a.ts)"


@query(_PAIRS + " SELECT user_id, now, cur, past, sum(past_n)::BIGINT AS n FROM p GROUP BY ALL")
def past_category_counts(spark, d):
    return h.past_counts(order_events(spark, d))


_SCALES = ", ".join(f"('{k}', {v})" for k, v in h.SCALES.items())
_VOTES = """, sc(scale, size) AS (VALUES {scales}), v AS (SELECT {keys}, scale, CAST(floor((now - t0) / size) AS INTEGER) AS slot, sum(past_n * cur_n) AS w FROM p, sc GROUP BY ALL)
SELECT {keys}, scale, CAST(slot + k AS INTEGER) AS idx, round(sum(w * pow(2.0, -abs(k))), 6) AS votes FROM v, (SELECT unnest(range(-3, 4)) AS k) GROUP BY ALL"""


@query(_PAIRS + _VOTES.format(scales=_SCALES, keys="past, cur"))
def soft_vote_windows(spark, d):
    return h.soft_votes(order_events(spark, d))


@query(_PAIRS + _VOTES.format(scales=_SCALES, keys="past"))
def soft_vote_history(spark, d):
    return h.soft_votes(order_events(spark, d), with_current=False)


@query(f", p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_ORDER}) - 1 AS idx FROM ev) SELECT user_id, ((ts > {CUTS[0]})::INT + (ts > {CUTS[1]})::INT) AS slice, min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx FROM p GROUP BY ALL")
def time_split_ranges(spark, d):
    r = h.slice_ranges(order_events(spark, d), ORDER, CUTS)
    return r.select("user_id", "slice", F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"))


@query(f", p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_ORDER}) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM ev), t AS (SELECT *, CASE WHEN idx < floor(0.9 * total) THEN 'head' ELSE 'tail' END AS part FROM p) SELECT user_id, part, count(*) AS n, sum(quantity) AS quantity FROM t GROUP BY ALL")
def head_tail_split(spark, d):
    return h.head_tail(order_events(spark, d), ORDER).groupBy("user_id", "part").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(f", p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_ORDER}) - 1 AS idx FROM ev), r AS (SELECT user_id, min(idx) AS a, max(idx) AS b FROM p WHERE ts > {CUTS[0]} AND ts <= {CUTS[1]} GROUP BY user_id) SELECT p.user_id, item_id, order_id, idx::BIGINT AS idx FROM p JOIN r ON p.user_id = r.user_id AND idx BETWEEN a AND b")
def range_slice(spark, d):
    e = order_events(spark, d)
    ranges = h.slice_ranges(e, ORDER, CUTS).where("slice = 1").drop("slice")
    return h.in_ranges(e, ranges, ORDER).select("user_id", "item_id", "order_id", F.col("idx").cast("long").alias("idx"))


@query(", s AS (SELECT user_id, ts, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM ev GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s")
def sessionize_orders(spark, d):
    s = h.sessions(order_events(spark, d))
    return s.select("user_id", "ts", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.col("session").cast("long").alias("session"))
