"""The scorer's fit at its optimum, its scores, and calibration against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import scorer as Z


def made(spark, n=4000):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, 1]
    z = 0.4 + 1.2 * x[:, 0] - 0.08 * (x[:, 1] - 5) + 6 * x[:, 2]
    y = (r.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    rows = [(f"c{k}", k, *map(float, row), None if k % 50 == 0 else float(label)) for k, (row, label) in enumerate(zip(x, y, strict=True))]
    rows = [(c, k, None if k % 17 == 0 else a, b, d, e, label) for c, k, a, b, d, e, label in rows]
    return spark.createDataFrame(rows, "company_id string, month int, a double, b double, d double, e double, y double").repartition(5)


@pytest.mark.parametrize("signs", [{"a": 1, "b": -1, "d": 1, "e": 1}, {"a": -1, "b": -1, "d": 1, "e": -1}, {"b": 1}])
def test_optimum(spark, signs):
    """Free weights have no gradient, held ones one that points out of bounds; all signs hold; no neighbour is better."""
    rows = made(spark).cache()
    s = Z.fit(rows, signs, "y")
    sign = np.array(list(signs.values()))
    u, g = np.array(s.weights) * sign, np.array(s.gradient)
    assert (u >= 0).all() and abs(g[0]) < 1e-6
    assert (np.abs(g[1:][u > 0]) < 1e-6).all() and (g[1:][u == 0] > -1e-6).all()
    known = Z.standardised(rows.where("y is not null"), s).select("y", *signs)
    n, names = known.count(), list(signs)
    near = [(s.intercept + t, s.weights) for t in (0.01, -0.01)] + [(s.intercept, tuple(w + (t * q if k == j else 0) for k, (w, q) in enumerate(zip(s.weights, sign, strict=True)))) for j in range(len(names)) for t in (0.01, -0.01) if u[j] + t >= 0]
    cost = [v + 0.5 * Z.RIDGE * n * float(np.dot(w, w)) for v, (_, w) in zip(Z.losses(known, names, "y", [(s.intercept, s.weights), *near]), [(s.intercept, s.weights), *near], strict=True)]
    assert min(cost[1:]) > cost[0] and abs(cost[0] - s.loss) < 1e-6 * abs(s.loss)
    rows.unpersist()


def test_held_weights(spark):
    s = Z.fit(made(spark), {"a": -1, "b": 1, "d": 1}, "y")
    assert s.weights[0] == 0 and s.weights[1] == 0 and s.weights[2] > 0


def test_sums(spark):
    rows = made(spark, 300).where("y is not null").fillna(0)
    got = Z.sums(rows, ["a", "b"], "y", 0.3, (0.5, -0.02)).first()
    t = rows.toPandas()
    x = np.stack([np.ones(len(t)), t.a, t.b])
    p = 1 / (1 + np.exp(-(0.3 + 0.5 * t.a - 0.02 * t.b)))
    every = ("one", "a", "b")
    assert got["n"] == len(t) and np.allclose([got[f"g_{c}"] for c in every], x @ (p - t.y))
    h = (x * (p * (1 - p)).to_numpy()) @ x.T
    assert all(np.isclose(got[f"h_{a}_{b}"], h[i, j]) for i, a in enumerate(every) for j, b in enumerate(every) if i <= j)


def test_scores_and_nothing(spark):
    rows = made(spark, 600)
    s = Z.fit(rows, {"a": 1, "d": 1}, "y")
    got = Z.scored(rows, s, F.col("month") % 2 == 0).toPandas()
    assert got.score.between(0, 100).all() and got[got.month % 2 == 1].score.max() <= Z.DORMANT_CAP < got.score.max()
    empty = Z.fit(rows.limit(0), {"a": 1, "d": 1}, "y")
    assert empty.weights == (0.0, 0.0) and empty.intercept == 0.0
    one = Z.fit(rows.withColumn("a", F.lit(1.0)), {"a": 1}, "y")
    assert abs(one.weights[0]) < 1e-6


def test_calibration(spark):
    r = np.random.default_rng(4)
    rows = [("e", float(s), None if k % 31 == 0 else float(r.random() < 1 / (1 + np.exp((s - 50) / 12)))) for k, s in enumerate(np.round(r.normal(50, 20, 3000).clip(0, 100), 1))]
    rows += [("flat", 10.0, 1.0), ("flat", 20.0, 1.0), ("up", 10.0, 0.0), ("up", 20.0, 1.0), ("none", None, 1.0)]
    counts = Z.counts(spark.createDataFrame(rows, "event string, score double, happened double").repartition(3))
    t = counts.where("event = 'e'").orderBy("score").toPandas()
    n, k = np.concatenate([[0], t.n.cumsum()]), np.concatenate([[0], t.k.cumsum()])
    m = len(t)
    want = [min(max((k[b] - k[a]) / (n[b] - n[a]) for b in range(i + 1, m + 1)) for a in range(i + 1)) for i in range(0, m, 7)]
    got = Z.calibration(counts).toPandas()
    blocks = got[got.event == "e"].sort_values("score_from")
    assert np.allclose([blocks[(blocks.score_from <= s) & (blocks.score_to >= s)].rate.iloc[0] for s in t.score[::7]], want)
    assert (np.diff(blocks.rate) < 0).all() and blocks.n.sum() == n[-1]
    assert [tuple(x) for x in got[got.event.isin(["flat", "up"])].sort_values("event").itertuples(index=False)] == [("flat", 10.0, 20.0, 2, 1.0), ("up", 10.0, 20.0, 2, 0.5)]
    curve = {x.event: x for x in Z.curves(counts).collect()}
    assert -1 / 12 * 1.15 < curve["e"].a < -1 / 12 * 0.85 and abs(-curve["e"].b / curve["e"].a - 50) < 3 and abs(curve["e"].base_rate - k[-1] / n[-1]) < 1e-9
