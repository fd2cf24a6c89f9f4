"""Curves against plain Python, feature profiles with their modes, and the comparison of decision sets."""

import random

import pytest
from pyspark.sql import functions as F

from lapstream.operators import audits as A
from lapstream.operators import curves as U
from lapstream.operators import features as X


def plain_curve(rows):
    """Points (threshold, precision, recall, hits) from the highest score down."""
    positive = sum(y for y, _ in rows)
    out = []
    for t in sorted({s for _, s in rows}, reverse=True):
        chosen = [y for y, s in rows if s >= t]
        out.append((t, sum(chosen) / len(chosen), sum(chosen) / positive, sum(chosen)))
    return out


def test_curves_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"{2022 + i % 2} :: GP", int(rng.random() < 0.3), rng.randint(0, 40) / 40) for i in range(700)]
    odd = [("2024 :: GP", 1, 0.5), ("2024 :: GP", 1, 0.6), ("2022 :: GP", 1, None), ("2022 :: GP", 0, float("nan"))]
    df = spark.createDataFrame(rows + odd, "race string, target_y int, raw_proba double")
    points = U.curves(df, ["raw_proba"], F.substring("race", 1, 4)).persist()
    measures = {r["group"]: r for r in U.discrimination(points).collect()}
    assert measures.keys() == {"2022", "2023", "overall"}  # 2024 has one class only
    near = {(r["group"], r["point_label"]): r for r in U.operating_points(points, {"a": 0.5, "b": 0.5126, "c": 0.5}).collect()}
    best = {r["group"]: r for r in U.best_points(points).collect()}
    assert {k[1] for k in near} == {"a", "b"}
    for group in measures:
        own = [(y, s) for race, y, s in rows + odd[:2] if group in ("overall", race[:4])]
        curve = plain_curve(own)
        ap = area = before = 0.0
        p0 = 1.0
        for _, p, r, _ in curve:
            ap, area, before, p0 = ap + (r - before) * p, area + (r - before) * (p + p0) / 2, r, p
        m = measures[group]
        assert (m["n_rows"], m["n_positive"]) == (len(own), sum(y for y, _ in own))
        assert m["pr_auc_ap"] == pytest.approx(ap, abs=1e-6) and m["pr_auc_trapz"] == pytest.approx(area, abs=1e-6)
        t, p, r, _ = min(curve, key=lambda x: (abs(x[0] - 0.5126), x[0]))
        assert (near[group, "b"]["effective_threshold"], near[group, "b"]["recall"]) == (t, pytest.approx(r, abs=1e-6))
        top = max(curve, key=lambda x: (round(2 * x[1] * x[2] / ((x[1] + x[2]) or 1), 12), -x[0]))
        assert best[group]["threshold"] == top[0]


def test_profiles():
    assert len(X.PROFILES) == 9
    assert X.profile_plan("baseline") == X.Plan("baseline", (), "off")
    plan = X.profile_plan("percent_race_team_v1_strict", ["rain, team", "", " rain"])
    assert plan.excludes == ("team", "rainfall", "hasGapAhead", "hasGapBehind", "lapTime", "rain") and plan.mode == "track_percentage_race_team_v1"
    assert X.profile_plan("drop_medium_v1", mode="track_percentage_v1").mode == "track_percentage_v1"
    for bad in ({"profile": "none"}, {"profile": "baseline", "mode": "none"}):
        with pytest.raises(ValueError):
            X.profile_plan(**bad)


def test_modes_see_only_the_past(spark):
    laps = spark.createDataFrame([("R", d, n, t, 10.0 * n, "T", 4) for n, ts in enumerate([(80.0, 90.0), (90.0, 90.0), (None, 80.0)], 1) for d, t in zip("AB", ts)], "race string, driver string, lapNumber int, lapTime double, trackTemp double, team string, totalLaps int")
    plan = X.profile_plan("percent_race_team_v1", ["trackTemp"])
    out = X.planned(X.with_mode(laps, plan.mode), plan, ["race", "driver", "lapNumber"])
    assert "team" not in out.columns and "trackTemp" not in out.columns and set(X.MODES[plan.mode]) <= set(out.columns)
    got = {(r["driver"], r["lapNumber"]): r for r in out.collect()}
    assert got["A", 1]["lapTime_vs_driver_prev_mean_pct"] == 1.0 and got["A", 2]["lapTime_vs_driver_prev_mean_pct"] == 90 / 80
    assert got["B", 3]["lapTime_vs_race_prev_lapbucket_mean_pct"] == 80 / 87.5 and got["A", 3]["lapTime_vs_team_prev_lapbucket_mean_pct"] == 1.0
    assert got["A", 3]["race_progress_pct"] == 0.75
    agnostic = X.profile_plan("track_agnostic_v1")
    with pytest.raises(ValueError, match="airTemp_expanding_z"):
        X.planned(X.with_mode(laps, agnostic.mode), agnostic)
    whole = laps.withColumns({c: F.col("trackTemp") for c in ("airTemp", "humidity", "speedTrap")})
    assert X.planned(X.with_mode(whole, agnostic.mode), agnostic).count() == 6


def test_comparator_invariance(spark):
    schema = "race string, driver string, lapNumber int, suggestionLabel string, matchedPitLap int, pitInWindow boolean, outcome string, exclusionReason string"
    good = spark.createDataFrame([("R", "A", 5, "PIT_NOW", 6, True, "1", ""), ("R", "A", 9, "good pit", None, False, "EXCLUDED", "NO_MATCH_WITHIN_HORIZON")], schema)
    bad = spark.createDataFrame([("R", "A", 5, "MONITOR", 8, False, "1", "late"), ("R", "A", 6, "PIT_NOW", 8, True, "2", "")], schema)
    got = lambda **sets: {r["check"]: r["status"] for r in A.comparator_invariance(sets).collect()}
    fine = got(heuristic=good, ml=good)
    assert len(fine) == 17 and set(fine.values()) == {"PASS"}
    mixed = got(heuristic=good, ml=bad)
    assert {k for k, v in mixed.items() if v == "FAIL"} == {f"ml_{k}" for k in ("actionable_label_contract", "outcome_domain", "match_distance_within_horizon", "one_to_one_target_consumption", "matched_rows_window_flag", "scored_rows_have_empty_exclusion_reason")} | {"comparator_invariance_overall"}
    assert got(heuristic=good, ml=good.withColumn("more", F.lit(1)))["comparator_schema_exact_match"] == "FAIL"
    assert got(heuristic=good, ml=good.limit(0))["comparator_invariance_overall"] == "FAIL"
    detail = {(r["section"], r["name"]): r["value"] for r in A.comparator_details({"heuristic": good, "ml": bad}).collect()}
    assert detail["ml", "max_match_distance"] == 3 and detail["heuristic", "rows_matched"] == 1 and detail["heuristic", "rows_scored"] == 1
