"""Queries of the scorer and its calibration, with their SQL. The fit itself has none: a test holds it against the
conditions of the optimum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import events as E
from ledgerlake.operators import score as S
from ledgerlake.operators import scorer as Z
from ledgerlake.plans.panel_queries import Domain, panel_ctes, rounded
from ledgerlake.plans.risk_queries import ORACLE_SQL as _RISK
from ledgerlake.plans.serving_queries import ORACLE_SQL as _SERVED
from ledgerlake.plans.serving_queries import scores
from ledgerlake.sources.staging import staged

#: Which features make a company healthier, and which less.
SIGNS = {"runway": 1, "oper_growth_12m": 1, "debt_burden": -1, "payroll_continuity_6m": 1, "activity_trend": 1, "transfer_dep": -1, "net_vol_6m": -1, "oper_persistence_6m": 1}
FLAGS = tuple(f"{n}_y3" for n in E.NAMES)
#: Weights at which the sums of a step are compared.
AT = 0.1


class Labelled:
    """Features of each month, the events of the three months after it, and whether none of those happens (healthy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.domain = Domain(spark, sf_dir)
        ahead = E.forward(E.evaluate(self.domain.full()), 3)
        features = rounded(S.features(self.domain.panel), 4)
        self.rows = staged(features.join(ahead, ["company_id", "month"]).withColumn("healthy", 1.0 - F.greatest(*FLAGS)), "labelled-months")

    def events(self, scored: DataFrame) -> DataFrame:
        """(event, score, happened)."""
        each = F.inline(F.array(*(F.struct(F.lit(f).alias("event"), F.col(f).alias("happened")) for f in FLAGS)))
        return scored.select("score", each)


def sc10_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Labelled(spark, sf_dir).rows.where("healthy is not null")
    around = Z.moments(rows, SIGNS)
    found = Z.sums(Z.standardised(rows, around), list(SIGNS), "healthy", 0.0, tuple(AT * s for s in SIGNS.values()))
    return rounded(Z.long(found), 4)


def sc10_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Labelled(spark, sf_dir)
    scorer = Z.fit(t.rows, SIGNS, "healthy")
    moved = t.domain.panel.select("company_id", "month", (F.col("inflow_op_3m") + F.col("outflow_op_3m") > 0).alias("moved"))
    found = Z.scored(t.rows.join(moved, ["company_id", "month"]), scorer, F.coalesce("moved", F.lit(False)))
    return rounded(Z.catalogue(scorer, Z.curves(Z.counts(t.events(found)))), 4)


def sc10_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the scores that the other queries serve, so that SQL can follow."""
    t = Labelled(spark, sf_dir)
    found = t.rows.join(scores(t.domain), ["company_id", "month"])
    return rounded(Z.calibration(Z.counts(t.events(found))), 6)


QUERIES = {"sc10_sums": sc10_sums, "sc10_scorer": sc10_scorer, "sc10_calibration": sc10_calibration}

_JOINED = f"f AS ({_SERVED['sc09_features']}), e AS ({_RISK['ev09_forward']}), j AS (SELECT f.*, {', '.join(f'e.{x}' for x in FLAGS)}, 1.0 - greatest({', '.join(f'e.{x}' for x in FLAGS)}) AS y FROM f JOIN e ON e.company_id = f.company_id AND e.month = f.month)"
_ALL = ["one", *SIGNS]
_LIST = [("n", "count(*)"), *((f"g_{a}", f"sum((p - y) * {a})") for a in _ALL), *((f"h_{a}_{b}", f"sum(p * (1 - p) * {a} * {b})") for k, a in enumerate(_ALL) for b in _ALL[k:])]
_SCORED = "SELECT company_id, month, round(least(greatest(50 + 40 * margin_3m, 0), 100), 1) AS score FROM panel WHERE margin_3m IS NOT NULL"
ORACLE_SQL = {
    "sc10_sums": f"""WITH {_JOINED}, k AS (SELECT * FROM j WHERE y IS NOT NULL), x AS (SELECT y, 1.0 AS one, {", ".join(f"CASE WHEN {n} IS NULL THEN 0.0 ELSE least(greatest(({n} - (SELECT avg({n}) FROM k)) / (SELECT coalesce(nullif(stddev_pop({n}), 0), 1) FROM k), -5.0), 5.0) END AS {n}" for n in SIGNS)} FROM k),
w AS (SELECT *, 1.0 / (1.0 + exp(-({" + ".join(f"{AT * s} * {n}" for n, s in SIGNS.items())}))) AS p FROM x)
SELECT name, CAST(round(value, 4) AS DOUBLE) + 0.0 AS value FROM (""" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({v} AS DOUBLE) AS value FROM w" for n, v in _LIST) + ") t",
}


def _calibration() -> str:
    """Rates that don't rise: the least over starts up to a score of the greatest mean over ends from it on."""
    return f"""{panel_ctes("panel")}, scores AS ({_SCORED}), {_JOINED},
r AS (SELECT event, score, happened FROM (SELECT s.score, {", ".join(f"j.{x}" for x in FLAGS)} FROM j JOIN scores s ON s.company_id = j.company_id AND s.month = j.month) UNPIVOT (happened FOR event IN ({", ".join(FLAGS)}))),
c AS (SELECT event, score, count(*) AS n, sum(happened) AS k, row_number() OVER (PARTITION BY event ORDER BY score) AS i FROM r WHERE score IS NOT NULL GROUP BY event, score),
t AS (SELECT *, sum(n) OVER w AS nn, sum(k) OVER w AS kk FROM c WINDOW w AS (PARTITION BY event ORDER BY i)),
m AS (SELECT a.event, a.i AS a, b.i AS b, (b.kk - a.kk + a.k) / (b.nn - a.nn + a.n) AS mean FROM t a JOIN t b ON b.event = a.event AND b.i >= a.i),
g AS (SELECT event, a, b AS i, max(mean) OVER (PARTITION BY event, a ORDER BY b DESC) AS best FROM m),
v AS (SELECT g.event, g.i, min(best) AS rate FROM g GROUP BY 1, 2)
SELECT v.event, min(c.score) AS score_from, max(c.score) AS score_to, CAST(sum(c.n) AS BIGINT) AS n, CAST(round(rate, 6) AS DOUBLE) + 0.0 AS rate FROM v JOIN c ON c.event = v.event AND c.i = v.i GROUP BY v.event, rate"""


ORACLE_SQL["sc10_calibration"] = _calibration()
