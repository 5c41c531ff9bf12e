"""Keys, texts, categories, dates and numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def composite_key(kind: Column, name: Column) -> Column:
    """``type_name``."""
    return F.concat_ws("_", kind.cast("string"), name)


def split_key(key: Column) -> tuple[Column, Column]:
    """Type and name of a composite key; names may hold underscores."""
    parts = F.split(key, "_", 2)
    return parts[0].try_cast("tinyint"), F.get(parts, F.lit(1))


def hash_number(key: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of an MD5 as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, digits), 16, 10).cast("bigint")


def normalize_text(x: Column) -> Column:
    """Lower case with runs of white space as one space."""
    return F.lower(F.regexp_replace(x, r"\s+", " "))


def strip_commas(x: Column) -> Column:
    return F.translate(x, ",", "")


def join_ampersands(x: Column) -> Column:
    return F.replace(x, F.lit(" & "), F.lit("&"))


def top_levels(category: Column, n: int) -> Column:
    """The first ``n`` levels of ``a|b|c``."""
    return F.substring_index(category, "|", n)


def category_prefixes(category: Column) -> Column:
    """``i_1c_a``, ``i_2c_a|b`` and so on."""
    parts = F.split(category, r"\|")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("i_"), n.cast("string"), F.lit("c_"), F.array_join(F.slice(parts, F.lit(1), n), "|")))


def category_nodes(paths: Column, first: int | None = None) -> Column:
    """Distinct nodes ``id-name`` of ``id-name/id-name|...``, leaf first, from the first ``first`` of each path."""
    lists = F.transform(F.split(paths, r"\|"), lambda p: F.slice(F.split(p, "/"), 1, first) if first else F.split(p, "/"))
    return F.array_distinct(F.filter(F.flatten(lists), lambda n: n != ""))


def node_ids(nodes: Column) -> Column:
    return F.array_distinct(F.transform(nodes, lambda n: F.substring_index(n, "-", 1)))


def depth_features(parents: Column, leaf: Column, kind: str = "i") -> Column:
    """Each node of the path by its depth from the top (c1 ...) and from the bottom (c-1 ...)."""
    path = F.concat(parents, F.array(leaf))
    name = lambda x, depth: F.concat(F.lit(f"{kind}_c"), depth.cast("string"), F.lit("_"), x)
    return F.flatten(F.transform(path, lambda x, i: F.array(name(x, i + 1), name(x, i - F.size(path)))))


def age_bucket(age: Column) -> Column:
    return F.floor(age.try_cast("double") / 5).cast("int")


def age_range_bucket(span: Column) -> Column:
    """The bucket of the low end of ``lo_hi``."""
    return age_bucket(F.substring_index(span, "_", 1))


def with_confidence(x: Column) -> tuple[Column, Column]:
    """Value and share of ``value_percent``."""
    return F.substring_index(x, "_", 1), F.substring_index(x, "_", -1).try_cast("double") / 100


def gender_sign(gender: Column) -> Column:
    return F.when(F.lower(gender).isin("female", "f"), -1.0).otherwise(1.0)


def year_offset(date: Column) -> Column:
    """Years since 1900 of ``Y-M-D``."""
    return F.substring_index(date, "-", 1).try_cast("int") - 1900


def title_year(title: Column) -> Column:
    """The year of ``Title (1999)``; null without one."""
    return F.nullif(F.regexp_extract(title, r"\((\d{4})\)", 1), F.lit("")).cast("int")


def days(seconds: Column) -> Column:
    return F.round(seconds / 86400, 3)


def attribute_map(x: Column) -> Column:
    """``k:v|k:v`` as a map, trimmed and in lower case; the last of a repeated key counts."""
    pairs = F.filter(F.split(F.lower(x), r"\|"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.get(F.split(p, ":", 2), F.lit(1))).alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def merchant_name(x: Column) -> Column:
    return F.substring_index(x, ",", 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bound_lambda(xi: Column, limit: bool = True) -> Column:
    """(sigmoid(xi) - 1/2) / (2 xi), whose limit at 0 is 1/8; without ``limit`` the bare quotient, NaN at 0 as in SQL."""
    if not limit:
        return F.when(xi == 0, float("nan")).otherwise((sigmoid(xi) - 0.5) / (2 * F.nullif(xi, F.lit(0.0))))
    return F.when(F.abs(xi) < 1e-8, 0.125).otherwise((sigmoid(xi) - 0.5) / (2 * F.when(F.abs(xi) < 1e-8, 1.0).otherwise(xi)))


def stop_free_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-case runs of letters and digits without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def falsy(x: Column) -> Column:
    """Missing as feature handlers see it: null, empty, or zero."""
    s = F.trim(x.cast("string"))
    return s.isNull() | (s == "") | (F.coalesce(s.try_cast("double"), F.lit(1.0)) == 0)


def one_hot(kind: str, attributes: dict[str, Column]) -> Column:
    """Each attribute that isn't missing as ``kind_attribute_value`` with value 1, as an array of (name, value)."""
    cells = [F.when(~falsy(c), F.struct(F.concat(F.lit(f"{kind}_{a}_"), normalize_text(c.cast("string"))).alias("name"), F.lit(1.0).alias("value"))) for a, c in attributes.items()]
    return F.array_compact(F.array(*cells))


def movie_user_features(gender: Column, attributes: dict[str, Column]) -> Column:
    """Attributes one-hot, and the gender as one feature of -1 or 1."""
    sign = F.array(F.struct(F.lit("gender").alias("name"), gender_sign(gender).alias("value")))
    return F.concat(F.when(falsy(gender), F.array().cast("array<struct<name:string,value:double>>")).otherwise(sign), one_hot("u", attributes))


def each_value(kind: str, values: Column) -> Column:
    """``kind_value`` of each value of an array, such as genres or authors; missing ones and repetitions are left out."""
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~falsy(v))
    return F.array_distinct(F.transform(some, lambda v: F.concat(F.lit(f"{kind}_"), normalize_text(v))))


def author_features(authors: Column) -> Column:
    """Features of an author list that is one name or a JSON array of names."""
    listed = F.when(F.startswith(F.trim(authors), F.lit("[")), F.from_json(authors, "array<string>")).otherwise(F.array(authors))
    return each_value("i_author", listed)


def merchant_feature(merchant: Column) -> Column:
    return F.concat(F.lit("m_"), normalize_text(merchant_name(merchant)))


def handler_group(feature: Column) -> Column:
    """The handlers' group of a feature by a fragment of its name: weights of terms, their inverse frequencies, or the name itself."""
    return F.when(F.contains(feature, F.lit("tfidf_")), F.lit("tfidf")).when(F.contains(feature, F.lit("tf_")), F.lit("tf")).otherwise(feature)


def loose_datetime(seconds: Column) -> Column:
    """``Y-M-D h:m:s`` in UTC without leading zeros."""
    t = F.timestamp_seconds(seconds)
    return F.concat(F.concat_ws("-", F.year(t), F.month(t), F.day(t)), F.lit(" "), F.concat_ws(":", F.hour(t), F.minute(t), F.second(t)))
