"""Explicit schemas and type codes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type codes of entities and interactions: fixed values.
ENTITY_TYPES = {"default": 0, "user": 1, "item": 2, "feature": 3}
RATE_ITEM, ADD_FEATURE = 8, 12
#: Activity codes of the event table's types; those of signup and error stand in for codes it lacks.
ACTIVITY_CODES = {"view": 0, "click": 5, "purchase": 8, "signup": 9, "error": 10}

ENTITIES = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("type", T.ByteType()), T.StructField("name", T.StringType()), T.StructField("desc", T.StringType())])
INTERACTIONS = T.StructType([T.StructField("from_id", T.LongType()), T.StructField("to_id", T.LongType()), T.StructField("type", T.ByteType()), T.StructField("value", T.FloatType()), T.StructField("desc", T.StringType())])
RATING_JSON = T.StructType([T.StructField(c, T.StringType()) for c in ("u", "i", "r", "d")])
USER_JSON = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "age", "gender")])
ITEM_JSON = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "c", "m")])
MOVIE_USER_JSON = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "gender", "age", "occupation", "zip")])
MOVIE_ITEM_JSON = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("genres", T.ArrayType(T.StringType()))])
RATING_TSV = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("ts", T.LongType())])
ORDER_TSV = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("datetime", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("quantity", T.IntegerType()), T.StructField("price", T.DoubleType()), T.StructField("category", T.StringType())])
PRODUCT_TSV = T.StructType([T.StructField(c, T.StringType()) for c in ("pid", "orig_pid", "catalog", "title", "description", "price", "sizes", "colors", "category", "attributes")])
TRIPLE_TSV = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("feat_id", T.LongType()), T.StructField("val", T.DoubleType())])
QUERY_PROFILE = T.StructType([T.StructField("id", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))])
