"""Column functions on lap, status, label and score values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, labels, limits and tables of the domain.
GREEN = "1"
CAUTION = ["4", "6", "7"]
SEVERITY = ["5", "4", "7", "6", "2", "1"]
POSITIVE_RESULTS = ["SUCCESS_UNDERCUT", "SUCCESS_OVERCUT", "SUCCESS_DEFEND", "SUCCESS_FREE_STOP", "OFFSET_ADVANTAGE"]
NEGATIVE_RESULTS = ["FAILURE_PACE_DEFICIT", "FAILURE_TRAFFIC", "OFFSET_DISADVANTAGE"]
LABEL_PRIORITY = {"PIT_NOW": 4, "GOOD_PIT": 3, "LOST_CHANCE": 2, "MONITOR": 1}
MAX_STINT = {"SOFT": 18.0, "MEDIUM": 30.0, "HARD": 40.0, "WET": 25.0, "INTERMEDIATE": 25.0}
BASE_THRESHOLD = {"SOFT": 0.012, "MEDIUM": 0.015, "HARD": 0.020, "WET": 0.025, "INTERMEDIATE": 0.025}
NEXT_COMPOUND = {"SOFT": "MEDIUM", "MEDIUM": "HARD", "HARD": "MEDIUM"}
GAP_FILL = 999.0
PIT_LOSS_DEFAULT = (22.0, 14.0, 11.0)


def choose(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def canonical_status(code: Column) -> Column:
    out = F.lit(GREEN)
    for c in reversed(SEVERITY):
        out = F.when(F.contains(code, F.lit(c)), F.lit(c)).otherwise(out)
    return out


def normalize_or_green(code: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit(GREEN))


def is_green(code: Column) -> Column:
    return normalize_or_green(code) == GREEN


def is_caution(code: Column) -> Column:
    return F.coalesce(code.isin(CAUTION), F.lit(False))


def parse_event_time(text: Column) -> Column:
    """Epoch milliseconds; a time without a zone is UTC; null and invalid are 0."""
    t = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
    return F.coalesce(F.unix_millis(t), F.lit(0).cast("long"))


def parse_mixed_ts(text: Column) -> Column:
    s = F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d) ", "$1T")
    s = F.regexp_replace(F.regexp_replace(s, "Z$", "+00:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return parse_event_time(s)


def normalize_label(value: Column) -> Column:
    t = F.trim(value)
    return F.when(value.isNull() | (t == "") | (F.lower(t) == "nan") | (t == "<NA>"), F.lit("")).otherwise(F.upper(F.replace(t, F.lit(" "), F.lit("_"))))


def year_of_race(race: Column) -> Column:
    return F.regexp_extract(race, r"^(\d{4}) :: ", 1).try_cast("int")


def strip_year_prefix(race: Column) -> Column:
    return F.regexp_replace(race, r"^\d{4} :: ", "")


def with_year_prefix(year: Column, race: Column) -> Column:
    return F.concat_ws(" :: ", year.cast("string"), race)


def select_pit_loss(status: Column, green: Column, vsc: Column, sc: Column) -> Column:
    s = normalize_or_green(status)
    return F.when(s == "4", sc).when(s.isin("6", "7"), vsc).when(s == GREEN, green)


def clip_ratio(x: Column, default: float, lo: float, hi: float) -> Column:
    fine = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(fine, F.lit(default))))


def clean_lap(lap_time: Column, pit_in: Column, pit_out: Column, status: Column) -> Column:
    return F.coalesce((lap_time > 0) & pit_in.isNull() & pit_out.isNull() & is_green(status), F.lit(False))


def accurate_or_pit(accurate: Column, pit_in: Column, pit_out: Column) -> Column:
    return F.coalesce(accurate, F.lit(False)) | pit_in.isNotNull() | pit_out.isNotNull()


def outcome_of(result: Column) -> Column:
    """'1', '0' or EXCLUDED of a normalised result."""
    return F.when(result.isin(POSITIVE_RESULTS), F.lit("1")).when(result.isin(NEGATIVE_RESULTS), F.lit("0")).otherwise(F.lit("EXCLUDED"))


def exclusion_reason(result: Column) -> Column:
    r = F.coalesce(result, F.lit(""))
    return (
        F.when(r.isin(POSITIVE_RESULTS + NEGATIVE_RESULTS), F.lit(""))
        .when(F.startswith(r, F.lit("UNRESOLVED_")) | (r == "WEATHER_SURVIVAL_STOP"), r)
        .when(r == "", F.lit("MISSING_RESULT"))
        .otherwise(F.concat(F.lit("UNMAPPED_RESULT_"), r))
    )


def format_lap_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000))


def near_miss_bucket(distance: Column, horizon: int = 2) -> Column:
    return F.when(distance.isNull(), F.lit("no_future")).when(distance <= horizon, F.lit("unexpected_within_horizon")).when(distance <= horizon + 3, F.lit("near_miss_3_5")).otherwise(F.lit("far_miss_6_plus"))


def alert_kind(payload: Column) -> Column:
    """The kind of a mixed alert, by which of its fields is there."""
    has = lambda f: F.get_json_object(payload, f"$.{f}").isNotNull()
    return F.when(has("suggestionLabel"), F.lit("pit_suggestion")).when(has("result"), F.lit("pit_eval")).when(has("delta"), F.lit("tire_drop")).when(has("brakeDate"), F.lit("lift_coast")).when(has("emergencePosition"), F.lit("drop_zone")).otherwise(F.lit("other"))


# Scores of a stop.
def track_status_score(status: Column) -> Column:
    return F.when(is_caution(status), F.lit(60.0)).otherwise(F.lit(0.0))


def pace_score(pace_ratio: Column, slow_laps: Column) -> Column:
    return F.when((slow_laps >= 1) & (pace_ratio > 0), 30.0 * F.least(F.lit(1.0), F.pow(pace_ratio / 0.02, F.lit(1.5)))).otherwise(F.lit(0.0))


def urgency_score(tyre_life: Column, max_stint: Column) -> Column:
    n = (tyre_life / max_stint - 0.70) / (1.0 - 0.70)
    return F.when(tyre_life / max_stint < 0.70, F.lit(0.0)).otherwise(30.0 * F.least(F.lit(1.0), n * n))


def strategy_penalty(lap: Column, total_laps: Column, next_max_stint: Column) -> Column:
    left = total_laps - lap
    return F.when((total_laps <= 0) | (left <= 0) | (next_max_stint >= left), F.lit(0.0)).otherwise(-15.0 * F.least(F.lit(1.0), (left - next_max_stint) / left * 3.0))


def end_of_race_penalty(lap: Column, total_laps: Column) -> Column:
    return F.when(total_laps <= 0, F.lit(0.0)).otherwise(-100.0 / (1.0 + F.exp(-15.0 * (lap / total_laps - 0.92))))


def traffic_score(gap: Column, car_tyre_life: Column) -> Column:
    """From the gap to the car ahead on track after a stop; null means clean air."""
    raw = F.when(gap.isNull() | (gap >= 3.0), F.lit(30.0)).when(gap >= 1.0, 30.0 * (gap - 1.0) / 2.0).when(gap >= 0, -30.0 * (1.0 - gap)).otherwise(F.lit(-30.0))
    return F.when((car_tyre_life >= 25) & (raw < 30.0), F.least(F.lit(30.0), raw + 5.0)).otherwise(raw)


def timing_pressure(pace_delta: Column, gap_delta: Column, urgency: Column, penalty: Column, traffic: Column, status: Column, rival: Column) -> Column:
    zero = F.lit(0.0)
    pace = 6.0 * F.least(F.lit(1.0), F.greatest(zero, pace_delta) / 0.003)
    gap = 4.0 * F.least(F.lit(1.0), F.greatest(zero, gap_delta) / 0.8)
    plan = F.when(penalty < 0, 2.0 * F.least(F.lit(1.0), F.abs(penalty) / 8.0)).otherwise(zero)
    road = F.when(traffic < 0, F.lit(-1.5)).when(traffic >= 20, F.lit(1.0)).otherwise(zero)
    raw = F.greatest(zero, F.least(F.lit(10.0), pace + gap + plan + F.least(F.lit(2.5), rival * 0.25) + road))
    return F.when((status > 0) | ((urgency < 8.0) & (rival <= 0)), zero).otherwise(raw)


def score_class(score: Column) -> Column:
    return F.when(score >= 80, F.lit("PIT_NOW")).when(score >= 60, F.lit("GOOD_PIT")).otherwise(F.lit("MONITOR"))


def decision_label(score: Column, pace: Column, urgency: Column, boosted_urgency: Column, traffic: Column, status: Column, penalty: Column, rival: Column, timing: Column, pace_delta: Column) -> Column:
    """Class of the score, promoted or held back by the gates on traffic and early action."""
    monitor = F.lit("MONITOR")
    label = score_class(score)
    label = F.when((label == "MONITOR") & (status <= 0) & (score >= 52) & (pace >= 8) & (boosted_urgency >= 10), F.lit("GOOD_PIT")).otherwise(label)
    label = F.when((label != "MONITOR") & (traffic < 0) & (urgency < 28), monitor).otherwise(label)
    planned, ready, escalates = penalty <= -3.0, timing >= 3.5, pace >= 18.0
    early = (boosted_urgency >= 12) & (planned | ready | escalates) | (escalates & planned & (ready | (pace_delta >= 0.001)))
    return F.when((label != "MONITOR") & (status <= 0) & (rival <= 0) & ~early, monitor).otherwise(label)


def explain_score(pace: Column, status: Column, traffic: Column, penalty: Column, urgency: Column, ending: Column, rival: Column, timing: Column) -> Column:
    parts = F.concat_ws(
        " + ",
        F.when(pace > 5, "pace drop"),
        F.when(rival > 0, "rival boxed"),
        F.when(timing >= 6, "window tightening").when(timing >= 3, "window forming"),
        F.when(status > 0, "SC/VSC opportunity"),
        F.when(traffic >= 25, "clean air").when(traffic > 0, "decent gap").when(traffic < -10, "traffic risk"),
        F.when(penalty < -5, "tight tire window"),
        F.when(urgency >= 20, "tire cliff").when(urgency >= 10, "closing window"),
        F.when(ending < -30, "race ending"),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("general"))


def classify_stop(pre_gap: Column, post_gap: Column, baseline: Column, first: Column, status: Column, compound: Column, traffic: Column) -> Column:
    delta = (post_gap - pre_gap) / baseline * 100.0
    plausible = (F.abs(pre_gap) <= 60) & (F.abs(post_gap) <= 60) & (F.abs(post_gap - pre_gap) <= 45)
    return (
        F.when(F.upper(compound).isin("INTERMEDIATE", "WET"), "WEATHER_SURVIVAL_STOP")
        .when(pre_gap.isNull(), "UNRESOLVED_MISSING_PRE_GAP")
        .when(post_gap.isNull(), "UNRESOLVED_MISSING_POST_GAP")
        .when(baseline <= 0, "UNRESOLVED_INVALID_BASELINE")
        .when(~plausible, "UNRESOLVED_MISSING_POST_GAP")
        .when(F.abs(delta) > 20, "UNRESOLVED_INCIDENT_FILTER")
        .when(is_caution(status) & (F.abs(delta) < 1), "SUCCESS_FREE_STOP")
        .when((delta < -0.5) & first, "SUCCESS_UNDERCUT")
        .when(delta < -0.5, "SUCCESS_OVERCUT")
        .when(traffic, "FAILURE_TRAFFIC")
        .when(F.abs(delta) <= 0.5, "SUCCESS_DEFEND")
        .otherwise("FAILURE_PACE_DEFICIT")
    )


#: Seconds that a stop costs under green, virtual safety car and safety car.
PIT_LOSS_BY_RACE = {
    "Bahrain Grand Prix": (22.0, 13.0, 10.0), "Saudi Arabian Grand Prix": (24.0, 14.5, 11.5), "Australian Grand Prix": (23.0, 14.0, 11.0), "Japanese Grand Prix": (24.0, 14.5, 11.5),
    "Chinese Grand Prix": (23.5, 14.0, 11.0), "Miami Grand Prix": (23.0, 14.0, 11.0), "Emilia Romagna Grand Prix": (23.0, 13.5, 10.5), "Monaco Grand Prix": (20.0, 12.0, 9.5),
    "Spanish Grand Prix": (22.5, 13.5, 10.5), "Canadian Grand Prix": (21.5, 13.0, 10.0), "Austrian Grand Prix": (21.0, 12.5, 9.5), "British Grand Prix": (22.5, 13.5, 10.5),
    "Hungarian Grand Prix": (21.5, 13.0, 10.0), "Belgian Grand Prix": (23.5, 14.0, 11.0), "Dutch Grand Prix": (21.5, 13.0, 10.0), "Italian Grand Prix": (25.0, 15.0, 12.0),
    "Azerbaijan Grand Prix": (24.5, 15.0, 12.0), "Singapore Grand Prix": (23.0, 14.0, 11.0), "United States Grand Prix": (22.5, 13.5, 10.5), "Mexico City Grand Prix": (22.0, 13.0, 10.0),
    "São Paulo Grand Prix": (23.0, 14.0, 11.0), "Las Vegas Grand Prix": (24.0, 14.5, 11.5), "Qatar Grand Prix": (22.5, 13.5, 10.5), "Abu Dhabi Grand Prix": (23.0, 14.0, 11.0),
    "French Grand Prix": (23.0, 14.0, 11.0), "Portuguese Grand Prix": (22.5, 13.5, 10.5),
}


def pit_losses(race: Column) -> list[Column]:
    """Green, virtual-safety-car and safety-car losses of a race name without its year; defaults for others."""
    return [choose(race, {k: v[i] for k, v in PIT_LOSS_BY_RACE.items()}, PIT_LOSS_DEFAULT[i]) for i in range(3)]
