"""Mixing sources to target weights by Poisson replication, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .base import masked, stored

#: A rate above this is a sum of equal independent parts, each inverted on its own seed.
PART = 8.0
#: Terms of a part's distribution: beyond them lies less than 2^-52.
TERMS = 48


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the key and a seed."""
    digits = F.substring(F.md5(F.concat_ws("|", key, F.lit(seed)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson(rate: Column, key: Column, seed: str) -> Column:
    """A Poisson count with mean ``rate``: the distribution function inverted at hash-seeded numbers."""
    parts = F.greatest(F.ceil(rate / F.lit(PART)), F.lit(1)).cast("int")
    each = rate / parts

    def count(part: Column) -> Column:
        u = uniform(F.concat_ws("#", key, part.cast("string")), seed)
        start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.lit(0).alias("n"))
        step = lambda s, k: F.struct((s["p"] * each / k).alias("p"), (s["cdf"] + s["p"] * each / k).alias("cdf"), (s["n"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, part: total + count(part))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = 0.5) -> DataFrame:
    """(source, docs, rate): how often a document of each source is to appear on average.

    A source's share of the mix is its weight over all weights; without ``weights`` the weight is the
    source's number of documents to ``power``. Sources that ``weights`` lacks get rate 0. The mix has
    ``epochs`` times the documents of the input, and the counts are of all documents.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("docs"))
    if weights is None:
        weight = F.pow(F.col("docs").cast("double"), F.lit(power))
    else:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.create_map()
        weight = F.coalesce(F.element_at(table.cast("map<string,double>"), F.coalesce("source", F.lit(""))), F.lit(0.0))
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("docs").alias("all_docs"))
    rate = F.coalesce(F.try_divide(F.lit(float(epochs)) * F.col("weight") * F.col("all_docs"), F.col("all_weight") * F.col("docs")), F.lit(0.0))
    return weighed.crossJoin(F.broadcast(total)).select("source", "docs", rate.alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = 0.5, seed: str = "mix-1") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global order by hash; new columns copy, mix_key.

    The count is seeded by doc_id alone, so it is the same on any partitioning. mix_key orders the whole
    result; ties fall by doc_id, copy and the text's hash.

    A row without doc_id is seeded by a hash of its text in place of the id, so such rows get counts and places of
    their own; a null source is a source of its own. Repeated rows get equal counts, each for itself. Empty and null
    texts are as others. Without documents or weights the result is empty. Input columns named copy or mix_key
    are replaced; other names are free.
    """
    out, shown = _mixed(docs, weights, epochs, power, seed)
    kept = [c for c, name in zip(shown, docs.columns) if name.lower() not in ("copy", "mix_key")]
    return out.select(*kept, F.col("_copy").alias("copy"), F.col("_mix_key").alias("mix_key"))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, power: float = 0.5, seed: str = "mix-1") -> DataFrame:
    """``mixed`` with the columns of ``docs`` alone, as they were."""
    out, shown = _mixed(docs, weights, epochs, power, seed)
    return out.select(*shown)


def _mixed(docs: DataFrame, weights: dict[str, float] | None, epochs: float, power: float, seed: str) -> tuple[DataFrame, list[Column]]:
    """The copies in order under masked names, with _copy and _mix_key, and the columns that restore the input's."""
    rates = stored(source_rates(docs.select("source"), weights, epochs, power).select("source", "rate"), "mix-rates").toDF("_source", "_rate")
    hidden, shown = masked(docs)
    at = {name.lower(): column for column, name in zip(hidden.columns, docs.columns)}
    key = F.coalesce(F.col(at["doc_id"]).cast("string"), F.concat(F.lit("text "), F.coalesce(F.xxhash64(at["text"]), F.lit(0)).cast("string")) if "text" in at else F.lit(""))
    rated = hidden.join(rates, F.col(at["source"]).eqNullSafe(F.col("_source")))
    counted = rated.withColumn("_n", poisson(F.col("_rate"), key, seed)).where("_n > 0")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.col("_copy").cast("string"), F.lit(seed + "-order")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    copies = copies.withColumn("_mix_key", order)
    ties = [F.xxhash64(at["text"])] if "text" in at else []
    return copies.orderBy("_mix_key", at["doc_id"], "_copy", *ties), shown
