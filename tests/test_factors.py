"""Factor models against plain numpy, entity by entity."""

from __future__ import annotations

import numpy as np
import pytest

from prefloom.models import factors, feedback, ranking

D = 2
R = [(u, i, float((u * 3 + i * 2) % 5 + 1)) for u in range(8) for i in range(6) if (u + i) % 3]
USER_X = [(u, 1 + k, 0.5 + (u + k) % 3) for u in range(8) for k in range(3) if (u + k) % 4]
ITEM_X = [(i, 10 + i % 2, 1.0) for i in range(6)]
SIGNS = [(u, 1 + k, float((u * k + u) % 2)) for u in range(8) for k in range(3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, fid long, x double")


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(R, "user_id long, item_id long, rating double")


def start(spark, ids, seed):
    rows = factors.seeded(spark.createDataFrame([(k,) for k in ids], "id long"), D, seed).collect()
    return {r.id: np.array(r["mean"]) for r in rows}


def hybrid(spark, sweeps, biases):
    """The model's updates as loops over dictionaries."""
    users, items = range(8), range(6)
    mean = {"u": start(spark, users, "user_id"), "i": start(spark, items, "item_id")}
    var = {s: {k: np.ones(D) for k in m} for s, m in mean.items()}
    x = {"u": USER_X, "i": ITEM_X}
    w = start(spark, {f for s in x.values() for _, f, _ in s}, "feature")
    wv, wp = {f: np.ones(D) for f in w}, np.ones(D)
    prior = {s: [np.zeros(D), np.ones(D)] for s in "ui"}
    g, p = np.mean([r for _, _, r in R]), 1.0
    b, bv, bp = {s: dict.fromkeys(m, 0.0) for s, m in mean.items()}, {s: dict.fromkeys(m, 0.0) for s, m in mean.items()}, {s: [0.0, 1.0] for s in "ui"}
    if biases:
        for _ in range(4):
            for k in users:
                b["u"][k] = np.mean([r - g - b["i"][i] for u, i, r in R if u == k])
            for k in items:
                b["i"][k] = np.mean([r - g - b["u"][u] for u, i, r in R if i == k])
        bv = {s: dict.fromkeys(m, 1.0) for s, m in mean.items()}
    log = []

    def content(s, e):
        mine = [(f, v) for k, f, v in x[s] if k == e]
        n = max(len(mine), 1)
        return sum((v * w[f] for f, v in mine), np.zeros(D)) / np.sqrt(n), sum((v * v * wv[f] for f, v in mine), np.zeros(D)) / n

    def met(s, e):
        return [(i if s == "u" else u, r - g - b["u"][u] - b["i"][i]) for u, i, r in R if (u if s == "u" else i) == e]

    for _ in range(sweeps):
        for s, o in ("ui", "iu"):
            for e in mean[s]:
                a = np.diag(prior[s][1]).astype(float)
                t = prior[s][1] * (prior[s][0] + content(s, e)[0])
                for other, r in met(s, e):
                    a += p * (np.outer(mean[o][other], mean[o][other]) + np.diag(var[o][other]))
                    t = t + p * r * mean[o][other]
                mean[s][e], var[s][e] = np.linalg.solve(a, t), np.diag(np.linalg.inv(a))
        new = {}
        for f in w:
            top, below = np.zeros(D), wp.copy()
            for s in "ui":
                for e, k, v in x[s]:
                    if k == f:
                        share = v / np.sqrt(sum(q == e for q, _, _ in x[s]))
                        top += share * (mean[s][e] - prior[s][0] - (content(s, e)[0] - share * w[f])) * prior[s][1]
                        below += share**2 * prior[s][1]
            new[f] = (top / below, 1 / below)
        w, wv = {f: 0.5 * w[f] + 0.5 * m for f, (m, _) in new.items()}, {f: v for f, (_, v) in new.items()}
        if len(w) > 2:
            wp = (len(w) / 2 - 1) / (sum(w[f] ** 2 + wv[f] for f in w) / 2)
        for s in "ui":
            n, shares = len(mean[s]), {e: content(s, e) for e in mean[s]}
            prior[s][0] = sum(mean[s][e] - shares[e][0] for e in mean[s]) / n
            prior[s][1] = (n / 2 - 1) / (sum((mean[s][e] - shares[e][0] - prior[s][0]) ** 2 + var[s][e] + shares[e][1] for e in mean[s]) / 2)
        if biases:
            for s in "ui":
                new = {}
                for e in mean[s]:
                    rest = [r - g - mean["u"][u] @ mean["i"][i] - b["i" if s == "u" else "u"][i if s == "u" else u] for u, i, r in R if (u if s == "u" else i) == e]
                    tau = bp[s][1] + len(rest) * p
                    new[e] = ((bp[s][1] * bp[s][0] + p * sum(rest)) / tau, 1 / tau)
                b[s], bv[s] = {e: m for e, (m, _) in new.items()}, {e: v for e, (_, v) in new.items()}
                bp[s][0] = np.mean(list(b[s].values()))
                bp[s][1] = (len(new) / 2 - 1) / (sum((b[s][e] - bp[s][0]) ** 2 + bv[s][e] for e in new) / 2)
        rest = np.array([r - mean["u"][u] @ mean["i"][i] - b["u"][u] - b["i"][i] for u, i, r in R])
        spread = sum(mean["u"][u] ** 2 @ var["i"][i] + mean["i"][i] ** 2 @ var["u"][u] + var["u"][u] @ var["i"][i] + bv["u"][u] + bv["i"][i] for u, i, _ in R)
        g = rest.mean()
        p = (len(R) / 2 - 1) / ((((rest - g) ** 2).sum() + spread + 1 / p) / 2)
        log.append(np.sqrt(((rest - g) ** 2).mean()))
    return mean, var, w, b, g, p, log


@pytest.mark.parametrize("biases", [False, True])
def test_hybrid_updates(spark, ratings, biases):
    m = factors.train(ratings, D, 3, frame(spark, USER_X), frame(spark, ITEM_X), biases)
    mean, var, w, b, g, p, log = hybrid(spark, 3, biases)
    assert (m.g, m.precision, m.log) == (pytest.approx(g), pytest.approx(p), pytest.approx(log))
    for side, s in ((m.users, "u"), (m.items, "i")):
        for r in side.vectors.collect():
            assert r["mean"] == pytest.approx(mean[s][r.id], abs=1e-6) and r["var"] == pytest.approx(var[s][r.id], abs=1e-6)
        if biases:
            assert {r.id: r.b for r in side.bias.collect()} == pytest.approx(b[s], abs=1e-6)
    assert {(r.id, k): v for r in m.weights.collect() for k, v in enumerate(r["mean"])} == pytest.approx({(f, k): v for f in w for k, v in enumerate(w[f])}, abs=1e-6)


def bound(xi):
    return 0.125 if abs(xi) < 1e-8 else (1 / (1 + np.exp(-xi)) - 0.5) / (2 * xi)


def of_feedback(spark, sweeps, logistic, values):
    """Implicit feedback of both sides as loops, with whole covariances."""
    mean = {"u": start(spark, range(8), "u"), "i": start(spark, range(6), "i")}
    x = values
    ws = {"u": start(spark, {f for _, f, _ in x["u"]}, "f"), "i": start(spark, {f for _, f, _ in x["i"]}, "h")}
    cov, wc = ({s: {k: np.eye(D) for k in m} for s, m in q.items()} for q in (mean, ws))
    fb, fp = ({s: dict.fromkeys(m, c) for s, m in ws.items()} for c in (0.0, 1.0))
    prior = {s: [np.zeros(D), np.ones(D)] for s in "ui"}
    fprior = {s: [np.zeros(D), np.full(D, float(logistic))] for s in "ui"}
    g, p, log = np.mean([r for _, _, r in R]), 1.0, []
    spread = lambda a, ca, c, cc: a @ cc @ a + c @ ca @ c + np.trace(ca @ cc)

    def weigh(s, e, f, v, m, c):
        if not logistic:
            return fp[s][f], fp[s][f] * v
        k = 2 * bound(np.sqrt((m @ ws[s][f] + fb[s][f]) ** 2 + spread(m, c, ws[s][f], wc[s][f])))
        return k, v - 0.5 - k * fb[s][f]

    def solve(prior_mean, prior_precision, parts):
        a, t = np.diag(prior_precision).astype(float), prior_precision * prior_mean
        for m, c, k, y in parts:
            a, t = a + k * (np.outer(m, m) + c), t + y * m
        return np.linalg.solve(a, t), np.linalg.inv(a)

    def fit(q, c):
        m = np.mean(list(q.values()), axis=0)
        return [m, 1 / np.mean([(q[e] - m) ** 2 + np.diag(c[e]) for e in q], axis=0)]

    for _ in range(sweeps):
        for s, o in ("ui", "iu"):
            new = {}
            for e in mean[s]:
                parts = [(mean[o][n], cov[o][n], p, p * (r - g)) for u, i, r in R for k, n in [(u, i) if s == "u" else (i, u)] if k == e]
                parts += [(ws[s][f], wc[s][f], *weigh(s, e, f, v, mean[s][e], cov[s][e])) for k, f, v in x[s] if k == e]
                new[e] = solve(*prior[s], parts)
            mean[s], cov[s] = ({e: v[k] for e, v in new.items()} for k in (0, 1))
        for s in "ui":
            new, weights = {}, {}
            for f in ws[s]:
                mine = [(e, v, *weigh(s, e, f, v, mean[s][e], cov[s][e])) for e, k, v in x[s] if k == f]
                weights[f] = mine
                new[f] = solve(*fprior[s], [(mean[s][e], cov[s][e], k, y) for e, v, k, y in mine])
            ws[s], wc[s] = ({f: v[k] for f, v in new.items()} for k in (0, 1))
            for f, mine in weights.items():
                if logistic:
                    fb[s][f] = sum(v - 0.5 - k * (mean[s][e] @ ws[s][f]) for e, v, k, _ in mine) / sum(k for _, _, k, _ in mine)
                else:
                    fp[s][f] = len(mine) / sum((v - mean[s][e] @ ws[s][f]) ** 2 + spread(mean[s][e], cov[s][e], ws[s][f], wc[s][f]) for e, v, _, _ in mine)
        rest = np.array([r - mean["u"][u] @ mean["i"][i] for u, i, r in R])
        g = rest.mean()
        error = ((rest - g) ** 2).sum()
        p = len(R) / (error + sum(spread(mean["u"][u], cov["u"][u], mean["i"][i], cov["i"][i]) for u, i, _ in R))
        log.append(np.sqrt(error / len(R)))
        for s in "ui":
            prior[s] = fit(mean[s], cov[s])
            if logistic:
                fprior[s] = fit(ws[s], wc[s])

    def new_user(mine):
        m, c = prior["u"][0], np.diag(1 / prior["u"][1])
        for _ in range(4 if logistic else 1):
            m, c = solve(*prior["u"], [(ws["u"][f], wc["u"][f], *weigh("u", None, f, v, m, c)) for f, v in mine])
        return m

    return mean, ws, g, p, log, new_user


@pytest.mark.parametrize("logistic", [False, True])
def test_feedback_updates(spark, ratings, logistic):
    values = {"u": SIGNS if logistic else USER_X, "i": ITEM_X}
    more = frame(spark, [*values["u"], (99, 1, 1.0), (99, 2, 0.0), (99, 77, 1.0)])
    held = {"cs": spark.createDataFrame([(99, 0, 3.0), (99, 55, 3.0)], "user_id long, item_id long, rating double"), "none": ratings.limit(0)}
    m = feedback.train(ratings, more, frame(spark, values["i"]), D, 3, logistic, held)
    mean, ws, g, p, log, new_user = of_feedback(spark, 3, logistic, values)
    assert (m.g, m.precision, m.log) == (pytest.approx(g), pytest.approx(p), pytest.approx(log))
    got = {(r.kind, r.id): r["mean"] for r in feedback.vectors(m).collect()}
    want = {("user", k): v for k, v in mean["u"].items()} | {("item", k): v for k, v in mean["i"].items()} | {("user_feature", k): v for k, v in ws["u"].items()} | {("item_feature", k): v for k, v in ws["i"].items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    score = g + new_user([(1, 1.0), (2, 0.0)]) @ mean["i"][0]
    scored = feedback.predict(m, held["cs"], more).collect()
    assert [r.item_id for r in scored] == [0] and scored[0].score == pytest.approx(score)
    assert m.errors[-1]["cs"] == pytest.approx(abs(score - 3)) and np.isnan(m.errors[-1]["none"])


def test_recommend(spark, ratings):
    """Every item scored for known and new users, the best first; a new user's place is the mean of known features."""
    x = frame(spark, [*USER_X, (99, 1, 1.0), (99, 2, 2.0), (99, 77, 1.0)])
    m = factors.train(ratings, D, 2, x, frame(spark, ITEM_X), biases=True, held={"test": ratings})
    assert len(m.errors) == 2 and m.errors[-1]["test"] == pytest.approx(m.log[-1])
    who = spark.createDataFrame([(0,), (99,), (99,), (None,), (500,)], "user_id long")
    got = factors.recommend(m, who, 4, x).collect()
    assert sorted((r.user_id, r["rank"]) for r in got) == [(u, k) for u in (0, 99, 500) for k in (1, 2, 3, 4)]
    pairs = who.dropna().distinct().crossJoin(ratings.select("item_id").distinct())
    scores = {(r.user_id, r.item_id): r.score for r in factors.predict(m, pairs, x).collect()}
    for u in (0, 99, 500):
        want = sorted(((-s, i) for (k, i), s in scores.items() if k == u))[:4]
        assert [(r.item_id, pytest.approx(r.score)) for r in sorted(got, key=lambda r: r["rank"]) if r.user_id == u] == [(i, -s) for s, i in want]
    w = {r.id: np.array(r["mean"]) for r in m.weights.collect()}
    place = m.users.mean + (w[1] + 2 * w[2]) / np.sqrt(3)
    items = {r.id: (np.array(r["mean"]), r.b) for r in m.items.vectors.join(m.items.bias, "id").collect()}
    assert scores[99, 0] == pytest.approx(m.g + place @ items[0][0] + m.users.bias_mean + items[0][1])


def test_blocks(spark, monkeypatch):
    """Small blocks give what one block gives, ties to the lesser item, and nothing of empty tables."""
    monkeypatch.setattr(ranking, "USERS", 2)
    monkeypatch.setattr(ranking, "ITEMS", 3)
    schema = lambda key: f"{key} long, vector array<double>, bias double"
    u = spark.createDataFrame([(k, [float(k), 1.0], 0.0) for k in range(5)], schema("user_id"))
    i = spark.createDataFrame([(k, [float(k % 3), 1.0], 0.5 * (k % 2)) for k in range(10)], schema("item_id"))
    got = sorted((r.user_id, r["rank"], r.item_id, r.score) for r in ranking.best(u, i, 4, 1.0).collect())
    want = [(a, n + 1, k, -s) for a in range(5) for n, (s, k) in enumerate(sorted((-(1.0 + a * (k % 3) + 1.0 + 0.5 * (k % 2)), k) for k in range(10))[:4])]
    assert got == want
    assert ranking.best(u.limit(0), i, 4).count() == 0 == ranking.best(u, i.limit(0), 4).count()
