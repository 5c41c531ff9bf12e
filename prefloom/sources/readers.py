"""File sources: JSON lines, delimited rows, sparse features, dictionaries, category trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import schema


def json_profiles(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """JSON lines under a schema; rows without id are left out and the last line of an id wins."""
    raw = spark.read.schema(fields).json(path).withColumn("_at", line_order()).where("id is not null")
    return last_wins(raw, "id", "_at")


def item_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of item profiles in JSON, the line as it stands; the last line of an id wins."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("line"), line_order().alias("_at"))
    return last_wins(raw.where("id is not null"), "id", "_at")


def line_order() -> Column:
    """Sorts the lines of text files as they stand: by file, by the split's place in it, by the line's place in the split."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): all lines with their numbers from 1."""
    from .sinks import dense_numbers

    lines = spark.read.text(path).select("value", line_order().alias("_k"))
    return dense_numbers(lines, "_k", "row").select("row", "value")


def rows_at(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The lines of ``path`` at the 1-based places that the file ``index`` lists; a place that it repeats counts once."""
    return numbered_lines(spark, path).join(row_index(spark, index).distinct(), "row", "left_semi")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest ``order``, by one partial aggregate."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, "_row.*")


def json_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings of quoted strings {"u", "i", "r", "d"}."""
    raw = spark.read.schema(schema.RATING_JSON).json(path)
    return raw.select(F.col("u").alias("user_id"), F.col("i").alias("item_id"), F.expr("try_cast(r AS double)").alias("rating"), F.expr("try_cast(d AS long)").alias("ts"))


def delimited(spark: SparkSession, path: str, fields: T.StructType, sep: str = "\t") -> DataFrame:
    """Delimited rows without quoting."""
    return spark.read.schema(fields).option("sep", sep).option("quote", "").csv(path)


def tab_rows(spark: SparkSession, path: str, fields: T.StructType, least: int) -> DataFrame:
    """Lines of at least ``least`` tab-separated columns, whatever is read of them: further columns are left, missing ones and
    those that don't fit their type are null."""
    p = F.split("value", "\t", -1)
    lines = spark.read.text(path).where(F.size(p) >= least)
    return lines.select(*[F.get(p, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def ratings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings of three or more columns: user, item, rating, and the time if there is one."""
    return tab_rows(spark, path, schema.RATING_TSV, 3)


def orders_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Order log with epoch seconds and normalised categories."""
    raw = delimited(spark, path, schema.ORDER_TSV)
    category = F.translate(F.replace("category", F.lit(" & "), F.lit("&")), ",", "")
    return raw.withColumn("ts", F.unix_timestamp("datetime")).withColumn("category", category).drop("datetime")


def products_tsv(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, schema.PRODUCT_TSV)


def sparse_triples(spark: SparkSession, path: str) -> DataFrame:
    return tab_rows(spark, path, schema.TRIPLE_TSV, 3)


def row_index(spark: SparkSession, path: str) -> DataFrame:
    """1-based row numbers, one a line."""
    return spark.read.schema("row long").csv(path).where("row is not null")


def sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``type_id,fid:val,...`` as (entity, fid, fval)."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where("p[0] <> ''")
    pair = F.explode(F.slice("p", 2, F.size("p"))).alias("pair")
    pairs = parts.where(F.size("p") > 1).select(F.col("p")[0].alias("entity"), pair).where("pair like '%:%'")
    return pairs.select("entity", F.substring_index("pair", ":", 1).cast("long").alias("fid"), F.substring_index("pair", ":", -1).cast("double").alias("fval"))


def feature_dictionary(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return delimited(spark, path, T.StructType([T.StructField("name", T.StringType()), T.StructField("fid", T.LongType())]), sep)


def category_tree(spark: SparkSession, path: str) -> DataFrame:
    """``cid, name, is_leaf, /a/b`` with the path as an array."""
    raw = delimited(spark, path, T.StructType([T.StructField("cid", T.StringType()), T.StructField("cname", T.StringType()), T.StructField("is_leaf", T.IntegerType()), T.StructField("path", T.StringType())]))
    return raw.select("cid", "cname", (F.col("is_leaf") == 1).alias("is_leaf"), F.split(F.expr("substring(path, 2)"), "/").alias("parent_nodes"))


def movielens_users(spark: SparkSession, path: str) -> DataFrame:
    """``id::gender::age::occupation::zip`` lines."""
    p = F.split("value", "::")
    return spark.read.text(path).select(*[p[i].alias(c) for i, c in enumerate(("id", "gender", "age", "occupation", "zip"))])


def movielens_items(spark: SparkSession, path: str) -> DataFrame:
    """``id::name::genre|genre`` lines."""
    p = F.split("value", "::")
    return spark.read.text(path).select(p[0].alias("id"), p[1].alias("name"), F.split(p[2], r"\|").alias("genres"))


def api_attributes(spark: SparkSession, path: str, paths: dict[str, str]) -> DataFrame:
    """Chosen attributes of JSON responses, one a line: name -> JSON path."""
    return spark.read.text(path).select(*[F.get_json_object("value", p).alias(n) for n, p in paths.items()])


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Iteration, seconds and RMSEs of the lines that a training run prints."""
    number = r"([-+0-9.eEnaif]+)"
    get = lambda name: F.regexp_extract("value", f"{name}:{number}", 1).try_cast("double")
    return spark.read.text(path).where("value like '%iteration:%'").select(get("iteration").cast("int").alias("iteration"), get("time").alias("time"), get("train rmse").alias("train_rmse"), get("test rmse").alias("test_rmse"), get("cs rmse").alias("cs_rmse"))


#: Readers by (dataset, entity).
REGISTRY: dict[tuple[str, str], Callable[[SparkSession, str], DataFrame]] = {
    ("amazon", "user"): lambda s, p: json_profiles(s, p, schema.USER_JSON),
    ("amazon", "item"): lambda s, p: json_profiles(s, p, schema.ITEM_JSON),
    ("movielens", "user"): lambda s, p: json_profiles(s, p, schema.MOVIE_USER_JSON),
    ("movielens", "item"): lambda s, p: json_profiles(s, p, schema.MOVIE_ITEM_JSON),
}


def reader(dataset: str, entity: str) -> Callable[[SparkSession, str], DataFrame]:
    try:
        return REGISTRY[dataset, entity]
    except KeyError:
        raise ValueError(f"no reader for {entity}s of {dataset}; there are {sorted(REGISTRY)}") from None
