from datetime import date

import pytest

from ledgerlake.operators import score as S


def run(spark, series):
    rows = [(k, date(2026, 1 + i, 1), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    out = {}
    for r in S.project(spark.createDataFrame(rows, "id string, month date, value double")).orderBy("id", "month").collect():
        out.setdefault(r.id, []).append(r.value)
    return out


def test_projection(spark):
    got = run(spark, {"flat": [50] * 5, "up": [50, 52, 54, 56, 58], "down": [58, 56, 54, 52, 50], "fall": [93.9, 93.0, 92.6, 89.4], "high": [70, 80, 90, 97, 100], "low": [30, 20, 10, 3, 0], "short": [1, 2, 3]})
    assert got["flat"] == [50, 50, 50]
    assert got["up"] == pytest.approx([59.2, 60.1, 60.9])
    assert [round(108 - x, 1) for x in got["down"]] == got["up"]
    assert got["fall"] == pytest.approx([88.4, 87.5, 86.8])
    assert max(got["high"]) <= 100 and min(got["low"]) >= 0 and "short" not in got


def test_run_after_a_gap(spark):
    rows = [("a", date(2025, 1, 1), 10.0), ("a", date(2025, 2, 1), 11.0), ("a", date(2025, 9, 1), 40.0), ("a", date(2025, 10, 1), 41.0), ("a", date(2025, 11, 1), None), ("a", date(2025, 12, 1), float("nan"))]
    got = S.trailing_run(spark.createDataFrame(rows, "id string, month date, value double"))
    assert sorted(r.value for r in got.collect()) == [40, 41]


def test_pillars(spark):
    rows = [("a", "runway", 20.0), ("a", "lc_util", None), ("a", "other", 2.0), ("a", "more", -3.0), ("b", "runway", 0.0)]
    got = {(r.k, r.pillar): (r.n_drivers, r.contribution) for r in S.pillars(spark.createDataFrame(rows, "k string, feature string, contribution double"), ["k"]).collect()}
    assert got == {("a", "liquidez"): (2, None), ("a", "additional"): (2, -1.0), ("b", "liquidez"): (1, 0.0)}


def test_attribution_closes(spark):
    scores = spark.createDataFrame([("a", date(2026, 1, 1), 60.0), ("a", date(2026, 2, 1), 55.0)], "id string, month date, value double")
    drivers = spark.createDataFrame([("a", date(2026, 1, 1), "x", 3.0), ("a", date(2026, 1, 1), "gone", 1.0), ("a", date(2026, 2, 1), "x", 1.5), ("a", date(2026, 2, 1), "new", 0.02)], "id string, month date, feature string, contribution double")
    got = {r.feature: r.delta_points for r in S.attribution(drivers, scores).collect()}
    assert got == {"x": -1.5, "gone": -1.0, "rules": -2.52}
