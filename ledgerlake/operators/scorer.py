"""A scorer whose weights keep the signs they are given, its scale, and the probabilities that its scores stand for.

The fit is a logistic regression by projected Newton steps. A step needs the sums of gradient and Hessian over all rows,
which combine in tasks; the driver sees (features + 1) squared numbers, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.columns import clip

#: Spreads at which a standardised feature is clipped; ridge on weights as a share of the rows; the largest projected
#: gradient that counts as none, as a share of the rows; steps at most; step lengths that are tried in one pass.
FAR, RIDGE, TOLERANCE, STEPS, LENGTHS = 5.0, 1e-4, 1e-9, 60, tuple(0.5**k for k in range(10))
#: Points of a score's mean and spread; the most that a company without movement scores; decimals of a score that is
#: calibrated, so that an event has at most 1,001 different scores.
MIDDLE, SPREAD, DORMANT_CAP, DECIMALS = 50.0, 15.0, 40.0, 1
#: Ridge of a curve, which keeps it finite where the score separates the cases.
HOLD = 0.1


@dataclass(frozen=True)
class Scorer:
    """Weights of standardised features; signs: 1 for weights of at least 0, -1 for at most 0."""

    signs: dict[str, int]
    mean: dict[str, float]
    spread: dict[str, float]
    intercept: float = 0.0
    weights: tuple[float, ...] = ()
    scale: tuple[float, float] = (MIDDLE, SPREAD)
    loss: float = math.inf
    gradient: tuple[float, ...] = ()


def moments(rows: DataFrame, signs: dict[str, int]) -> Scorer:
    """A scorer without weights that knows each feature's mean and spread; a constant feature has the spread 1."""
    found = rows.agg(*(f(n).alias(f"{n}_{k}") for n in signs for k, f in (("mean", F.avg), ("spread", F.stddev_pop)))).first()
    mean = {n: found[f"{n}_mean"] or 0.0 for n in signs}
    return Scorer(signs, mean, {n: found[f"{n}_spread"] or 1.0 for n in signs}, weights=(0.0,) * len(signs))


def standardised(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows with each feature in spreads from its mean, within FAR; an unknown value counts as the mean."""
    return rows.withColumns({n: F.coalesce(clip((F.col(n) - scorer.mean[n]) / F.lit(scorer.spread[n]), -FAR, FAR), F.lit(0.0)) for n in scorer.signs})


def predictor(names: list[str], intercept: float, weights: tuple[float, ...]) -> Column:
    out = F.lit(float(intercept))
    for n, w in zip(names, weights, strict=True):
        out = out + F.lit(float(w)) * F.col(n)
    return out


def sums(rows: DataFrame, names: list[str], label: str, intercept: float, weights: tuple[float, ...]) -> DataFrame:
    """One row: n, and of the logistic loss the gradient g_<name> and the Hessian h_<name>_<name>; the intercept is "one"."""
    each = rows.select(label, *names, predictor(names, intercept, weights).alias("z")).withColumns({"one": F.lit(1.0), "p": 1.0 / (1.0 + F.exp(-F.col("z")))})
    every = ["one", *names]
    miss, curve = F.col("p") - F.col(label), F.col("p") * (1.0 - F.col("p"))
    gradient = [F.sum(miss * F.col(a)).alias(f"g_{a}") for a in every]
    hessian = [F.sum(curve * F.col(a) * F.col(b)).alias(f"h_{a}_{b}") for k, a in enumerate(every) for b in every[k:]]
    return each.agg(F.count(F.lit(1)).alias("n"), *gradient, *hessian)


def losses(rows: DataFrame, names: list[str], label: str, candidates: list[tuple[float, tuple[float, ...]]]) -> list[float]:
    """The logistic loss of each candidate (intercept, weights), all in one pass."""
    z = [predictor(names, b, w) for b, w in candidates]
    found = rows.agg(*(F.sum(F.greatest(x, F.lit(0.0)) - x * F.col(label) + F.log1p(F.exp(-F.abs(x)))).alias(f"l{k}") for k, x in enumerate(z))).first()
    return [v or 0.0 for v in found]


def fit(rows: DataFrame, signs: dict[str, int], label: str, ridge: float = RIDGE) -> Scorer:
    """The scorer of rows(features, label 0 or 1), whose weights minimise the loss plus a ridge among those of the signs.

    Rows without a label don't count. Each step solves for the weights that aren't held at 0, and takes of LENGTHS the one
    of the least loss; it ends when no weight may move: the gradient of free weights is 0, and that of held ones points out
    of bounds. Without rows all weights are 0. rows is read twice a step: stage it.
    """
    names = list(signs)
    rows = rows.where(F.col(label).isNotNull()).select(label, *names)
    scorer = moments(rows, signs)
    rows = standardised(rows, scorer)
    sign = np.array([0, *signs.values()])
    u = np.zeros(len(names) + 1)  # the intercept, then the weights times their signs, which are at least 0
    turn = np.where(sign == 0, 1, sign)
    bound = sign != 0
    value = None
    for _ in range(STEPS):
        found = sums(rows, names, label, u[0], tuple((u * turn)[1:])).first()
        n = found["n"]
        if not n:
            break
        every = ["one", *names]
        hessian = np.array([[found[f"h_{a}_{b}"] if j <= k else found[f"h_{b}_{a}"] for k, b in enumerate(every)] for j, a in enumerate(every)]) * np.outer(turn, turn)
        hold = ridge * n * bound
        gradient = np.array([found[f"g_{a}"] for a in every]) * turn + hold * u
        scorer = replace(scorer, gradient=tuple(gradient / n))
        free = ~(bound & (u <= 0) & (gradient > 0))
        if np.abs(gradient[free]).max(initial=0) <= TOLERANCE * n:
            break
        step = np.zeros_like(u)
        step[free] = -np.linalg.solve((hessian + np.diag(hold + 1e-12 * n))[np.ix_(free, free)], gradient[free])
        tried = [np.where(bound, np.maximum(u + t * step, 0), u + t * step) for t in LENGTHS]
        got = [v + 0.5 * float(hold @ (x * x)) for v, x in zip(losses(rows, names, label, [(x[0], tuple((x * turn)[1:])) for x in tried]), tried, strict=True)]
        best = int(np.argmin(got))
        if value is not None and got[best] >= value:
            break
        u, value = tried[best], got[best]
    z = predictor(names, u[0], tuple((u * turn)[1:]))
    at, by = rows.agg(F.avg(z), F.stddev_pop(z)).first()
    b = SPREAD / by if by else 0.0
    return replace(scorer, intercept=float(u[0]), weights=tuple(float(x) for x in (u * turn)[1:]), scale=(MIDDLE - b * (at or 0.0), b), loss=value if value is not None else math.inf)


def scored(rows: DataFrame, scorer: Scorer, moved: Column | None = None) -> DataFrame:
    """rows with their score from 0 to 100; where moved is false, of DORMANT_CAP at most."""
    a, b = scorer.scale
    names = list(scorer.signs)
    z = standardised(rows.select("company_id", "month", *names), scorer).select("company_id", "month", clip(a + b * predictor(names, scorer.intercept, scorer.weights), 0, 100).alias("score"))
    out = rows.join(z, ["company_id", "month"])
    return out if moved is None else out.withColumn("score", F.when(moved, F.col("score")).otherwise(F.least("score", F.lit(DORMANT_CAP))))


def counts(rows: DataFrame) -> DataFrame:
    """(event, score, n, k) of rows(event, score, happened): how many rows of a score, rounded, and of how many it is true."""
    known = rows.where("score is not null and happened is not null")
    return known.groupBy("event", F.round("score", DECIMALS).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("happened").cast("long")).alias("k"))


def _pooled(table: pd.DataFrame) -> pd.DataFrame:
    blocks: list[list] = []
    for event, score, n, k in table.sort_values("score")[["event", "score", "n", "k"]].itertuples(index=False):
        blocks.append([event, score, score, n, k])
        while len(blocks) > 1 and blocks[-2][4] * blocks[-1][3] <= blocks[-1][4] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [event, blocks[-1][1], last[2], blocks[-1][3] + last[3], blocks[-1][4] + last[4]]
    return pd.DataFrame([(*b[:4], b[4] / b[3]) for b in blocks], columns=["event", "score_from", "score_to", "n", "rate"])


def calibration(grouped: DataFrame) -> DataFrame:
    """(event, score_from, score_to, n, rate): the rates that never rise with the score and fit counts() best.

    Adjacent violators are pooled. An event's counts are one group of at most 1,001 rows, however many rows were counted.
    """
    return grouped.groupBy("event").applyInPandas(_pooled, "event string, score_from double, score_to double, n long, rate double")


def _curve(table: pd.DataFrame) -> pd.DataFrame:
    x, n, k = table["score"].to_numpy() / 100 - 0.5, table["n"].to_numpy(float), table["k"].to_numpy(float)
    ab, base = np.zeros(2), k.sum() / n.sum()
    design = np.stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ab @ design, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + HOLD * np.eye(2), design @ (k - n * p) - HOLD * ab)
        ab = ab + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    slope = ab[1] / 100
    return pd.DataFrame([(table["event"].iloc[0], slope, ab[0] - 50 * slope, base)], columns=["event", "a", "b", "base_rate"])


def curves(grouped: DataFrame) -> DataFrame:
    """(event, a, b, base_rate): the logistic curve b + a * score of each event, and how often it happens at all."""
    return grouped.groupBy("event").applyInPandas(_curve, "event string, a double, b double, base_rate double")


def catalogue(scorer: Scorer, found: DataFrame) -> DataFrame:
    """(kind, name, a, b, base_rate): weights by name, the scale, the cap, and the curves of found."""
    own = [("weight", n, w, None, None) for n, w in zip(scorer.signs, scorer.weights, strict=True)] + [("scale", "score", *scorer.scale, None), ("cap", "dormant", DORMANT_CAP, None, None)]
    fixed = found.sparkSession.createDataFrame([(k, n, *(None if x is None else float(x) for x in r)) for k, n, *r in own], "kind string, name string, a double, b double, base_rate double")
    return fixed.unionByName(found.select(F.lit("curve").alias("kind"), F.col("event").alias("name"), "a", "b", "base_rate"))


def long(found: DataFrame) -> DataFrame:
    """sums() as rows (name, value)."""
    return found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in found.columns))))
