"""Factorisation of ratings together with both sides' features, by expectation and maximisation.

Features of users and of items are two more matrices that share the users' and the items' vectors. Gaussian:
a feature's values have a variance of their own. Logistic: values are 0 or 1 under the quadratic bound of the
sigmoid, with a bias b and a contact point xi for each edge. Posteriors keep whole covariances, packed as upper
triangles; messages are grouped sums of columns, as in ``factors``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bound_lambda
from ..sources.checkpoints import cut
from .factors import dot, error_of, messages, seeded, solved, triangle


@dataclass
class Side:
    """Users or items with their features' values x (id, fid, x) and vectors (id, mean, var, b, p)."""

    key: str
    vectors: DataFrame
    x: DataFrame | None
    feats: DataFrame | None
    mean: np.ndarray
    precision: np.ndarray
    feat_mean: np.ndarray
    feat_precision: np.ndarray  # 0 without a prior: Gaussian features have none


@dataclass
class Feedback:
    ratings: DataFrame
    d: int
    logistic: bool
    users: Side
    items: Side
    g: float
    precision: float
    n: int
    log: list[float] = field(default_factory=list)
    errors: list[dict[str, float]] = field(default_factory=list)


def numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def spread(a: str, ca: str, b: str, cb: str, d: int) -> Column:
    """The variance of a.b: a'Cb a + b'Ca b + tr(Ca Cb), of packed covariances."""
    at, out = lambda c, k: F.get(c, F.lit(k)), F.lit(0.0)
    for k, (i, j) in enumerate(triangle(d)):
        out = out + (1.0 if i == j else 2.0) * (at(a, i) * at(a, j) * at(cb, k) + at(b, i) * at(b, j) * at(ca, k) + at(ca, k) * at(cb, k))
    return out


def edges(m: Feedback, side: Side, at: DataFrame, x: DataFrame) -> DataFrame:
    """Values ``x`` of the entities ``at`` with both ends (me, ve, mf, vf), weight w and target t; unknown features have no edge."""
    e = at.select("id", F.col("mean").alias("me"), F.col("var").alias("ve"))
    f = side.feats.select(F.col("id").alias("fid"), F.col("mean").alias("mf"), F.col("var").alias("vf"), "b", "p")
    rows = x.join(e, "id").join(f, "fid")
    if not m.logistic:
        return rows.withColumn("w", F.col("p")).withColumn("t", F.col("p") * F.col("x"))
    p = dot(F.col("me"), F.col("mf")) + F.col("b")
    lam = bound_lambda(F.sqrt(p * p + spread("me", "ve", "mf", "vf", m.d)))
    return rows.withColumn("w", 2 * lam).withColumn("t", F.col("x") - 0.5 - F.col("w") * F.col("b"))


def to_entities(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("mf").alias("mean"), F.col("vf").alias("var"), F.col("w").alias("weight"), F.col("t").alias("target"))


def update_entities(m: Feedback, side: Side, other: Side) -> None:
    v = other.vectors.select(F.col("id").alias(other.key), "mean", "var")
    met = m.ratings.join(v, other.key).select(F.col(side.key).alias("id"), "mean", "var", F.lit(m.precision).alias("weight"), ((F.col("rating") - m.g) * m.precision).alias("target"))
    if side.x is not None:
        met = met.unionByName(to_entities(edges(m, side, side.vectors, side.x)))
    side.vectors = cut(solved(side.vectors.select("id"), messages(met, m.d, True), m.d, side.precision, numbers(side.mean), True))


def update_features(m: Feedback, side: Side) -> None:
    """The features' vectors, then their biases or precisions."""
    met = cut(edges(m, side, side.vectors, side.x))
    sent = met.select(F.col("fid").alias("id"), F.col("me").alias("mean"), F.col("ve").alias("var"), F.col("w").alias("weight"), F.col("t").alias("target"))
    new = cut(solved(side.feats.select("id"), messages(sent, m.d, True), m.d, side.feat_precision, numbers(side.feat_mean), True))
    again = met.drop("mf", "vf").join(new.select(F.col("id").alias("fid"), F.col("mean").alias("mf"), F.col("var").alias("vf")), "fid")
    p = dot(F.col("me"), F.col("mf"))
    if m.logistic:
        scalar = again.groupBy(F.col("fid").alias("id")).agg((F.sum(F.col("x") - 0.5 - F.col("w") * p) / F.sum("w")).alias("b"), F.lit(1.0).alias("p"))
    else:
        miss = F.pow(F.col("x") - p, F.lit(2.0)) + spread("me", "ve", "mf", "vf", m.d)
        scalar = again.groupBy(F.col("fid").alias("id")).agg(F.lit(0.0).alias("b"), (F.count("*") / F.greatest(F.sum(miss), F.lit(1e-6))).alias("p"))
    side.feats = cut(new.join(scalar, "id"))


def empirical(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the vectors and, by dimension, the inverse of their mean square about it with their variances."""
    at = lambda c, k: F.get(c, F.lit(k))
    diagonal = [k for k, (i, j) in enumerate(triangle(d)) if i == j]
    mean = np.array(rows.agg(*[F.avg(at("mean", k)) for k in range(d)]).first(), float)
    square = rows.agg(*[F.avg(F.pow(at("mean", k) - float(mean[k]), F.lit(2.0)) + at("var", diagonal[k])) for k in range(d)]).first()
    return mean, 1 / np.maximum(np.array(square, float), 1e-9)


def update_scalars(m: Feedback) -> None:
    """Global bias and the rating's precision, from the sums of residuals, their squares and the products' variances."""
    u = m.users.vectors.select(F.col("id").alias("user_id"), F.col("mean").alias("mu"), F.col("var").alias("vu"))
    i = m.items.vectors.select(F.col("id").alias("item_id"), F.col("mean").alias("mi"), F.col("var").alias("vi"))
    rest = F.col("rating") - dot(F.col("mu"), F.col("mi"))
    s, q, v = m.ratings.join(u, "user_id").join(i, "item_id").agg(F.sum(rest), F.sum(rest * rest), F.sum(spread("mu", "vu", "mi", "vi", m.d))).first()
    m.g = s / m.n
    error = q - m.n * m.g * m.g
    m.precision = m.n / max(error + v, 1e-9)
    m.log.append(float(np.sqrt(max(error, 0) / m.n)))


def train(ratings: DataFrame, user_features: DataFrame | None = None, item_features: DataFrame | None = None, d: int = 5, sweeps: int = 3, logistic: bool = False, held: dict[str, DataFrame] | None = None) -> Feedback:
    """The model of (user_id, item_id, rating) with features (id, fid, x) of either side.

    Only rated entities' features teach; ``held`` sets of ratings are scored after each sweep into ``errors``, their
    new users placed by features. Each sweep: users, items, both sides' features, global bias and variance, priors.
    Without ratings it is an error; rows with a null id, feature or value teach nothing.
    """
    r = cut(ratings.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.col("rating").cast("double")).dropna())
    n, g = r.agg(F.count("*"), F.avg("rating")).first()
    if not n:
        raise ValueError("there are no ratings")

    def side(key: str, features: DataFrame | None) -> Side:
        unit = F.array(*[F.lit(float(i == j)) for i, j in triangle(d)])
        start = lambda ids, seed: seeded(ids, d, seed).withColumn("var", unit)
        rows = cut(start(r.select(F.col(key).alias("id")).distinct(), key[0]))
        x = feats = None
        if features is not None:
            x = cut(valued(features).join(rows.select("id"), "id", "left_semi"))
            feats = cut(start(x.select(F.col("fid").alias("id")).distinct(), "f" if key == "user_id" else "h").withColumn("b", F.lit(0.0)).withColumn("p", F.lit(1.0)))
            x, feats = (None, None) if feats.isEmpty() else (x, feats)
        return Side(key, rows, x, feats, np.zeros(d), np.ones(d), np.zeros(d), np.ones(d) if logistic else np.zeros(d))

    m = Feedback(r, d, logistic, side("user_id", user_features), side("item_id", item_features), g, 1.0, n)
    for _ in range(sweeps):
        update_entities(m, m.users, m.items)
        update_entities(m, m.items, m.users)
        for s in (m.users, m.items):
            if s.feats is not None:
                update_features(m, s)
        update_scalars(m)
        for s in (m.users, m.items):
            s.mean, s.precision = empirical(s.vectors, d)
            if logistic and s.feats is not None:
                s.feat_mean, s.feat_precision = empirical(s.feats, d)
        m.errors.append({name: error_of(predict(m, df, user_features)) for name, df in (held or {}).items()})
    return m


def valued(features: DataFrame) -> DataFrame:
    return features.select(F.col("id").cast("long"), F.col("fid").cast("long"), F.col("x").cast("double")).dropna()


def place(m: Feedback, side: Side, ids: DataFrame, features: DataFrame | None = None, rounds: int = 4) -> DataFrame:
    """(id, mean, var) of ``ids``: known vectors, else the prior's updated by features.

    The logistic model's contact points follow the vector, so a new entity takes ``rounds`` rounds; the Gaussian
    one's first is its last.
    """
    known = ids.join(side.vectors, "id")
    spread0 = numbers(np.array([1 / side.precision[i] if i == j else 0.0 for i, j in triangle(m.d)]))
    new = ids.join(side.vectors.select("id"), "id", "left_anti").select("id", numbers(side.mean).alias("mean"), spread0.alias("var"))
    if features is not None and side.feats is not None:
        x = valued(features)
        new, x = cut(new), cut(x.join(new.select("id"), "id", "left_semi"))
        for _ in range(rounds if m.logistic else 1):
            new = cut(solved(new.select("id"), messages(to_entities(edges(m, side, new, x)), m.d, True), m.d, side.precision, numbers(side.mean), True))
    return known.unionByName(new)


def predict(m: Feedback, pairs: DataFrame, user_features: DataFrame | None = None) -> DataFrame:
    """``pairs`` with score; pairs of items without ratings leave, new users are placed by their features."""
    ids = pairs.select(F.col("user_id").cast("long").alias("id")).where("id is not null").distinct()
    u = place(m, m.users, ids, user_features).select(F.col("id").alias("user_id"), F.col("mean").alias("_u"))
    i = m.items.vectors.select(F.col("id").alias("item_id"), F.col("mean").alias("_i"))
    return pairs.join(u, "user_id").join(i, "item_id").withColumn("score", m.g + dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")


def vectors(m: Feedback) -> DataFrame:
    """All vectors as (kind, id, mean, var), var by dimension."""
    diagonal = [k for k, (i, j) in enumerate(triangle(m.d)) if i == j]
    parts = []
    for kind, side in (("user", m.users), ("item", m.items)):
        for name, rows in ((kind, side.vectors), (f"{kind}_feature", side.feats)):
            if rows is not None:
                parts.append(rows.select(F.lit(name).alias("kind"), "id", "mean", F.array(*[F.get("var", F.lit(k)) for k in diagonal]).alias("var")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
