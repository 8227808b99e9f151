"""Queries of the feature table and of what is learned from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import features
from furlong.plans.registry import HISTORY_SQL, ORACLE_SQL, query, tidy
from furlong.sources import racing

_PAST = """form as (select r.*, (finishing_position - 1) * 1.25::double as beaten, (90 + (draw * 7 + horse_id) % 20)::double as speed, case jockey_id % 4 when 0 then 5 when 1 then 3 end as claim,
    (rank() over (partition by race_id order by draw) - 0.5) / count(*) over (partition by race_id) as q from runners r),
roles as (select *, case when q <= 0.25 then 'LEADER' when q <= 0.5 then 'PRONOUNCED_PACE' when q <= 0.75 then 'MIDDIVISION' else 'HOLD_UP' end as role, weight_lbs - avg(weight_lbs) over (partition by race_id) as w_mean from form),
places as (select runner_id as h_id, race_id as h_race, horse_id as h_horse, case when field_size > 1 then (field_size - (1 + (draw * 3 + 3) % field_size))::double / (field_size - 1) end as p3, case when field_size > 1 then (field_size - (1 + (draw * 3 + 1) % field_size))::double / (field_size - 1) end as p1,
    case when field_size > 1 then (field_size - finishing_position)::double / (field_size - 1) end as pf, (finishing_position - 1) * 1.25::double as beaten, (90 + (draw * 7 + horse_id) % 20)::double as speed from runners),
far as (select runner_id as m_id, max(distance_f) as furthest from past group by 1),
runs as (select past.*, p3, p1, pf, p1 - p3 as t, pf - p1 as l, beaten, speed, furthest from past join places on h_race = past.race_id and h_horse = past.horse_id join far on m_id = past.runner_id),
b5 as (select runner_id, regr_slope(beaten, x) as beaten_trend from (select runner_id, beaten, -row_number() over (partition by runner_id order by rn) as x from runs where rn <= 5 and beaten is not null) group by 1 having count(*) >= 2),
s5 as (select runner_id, regr_slope(speed, x) as speed_trend from (select runner_id, speed, -row_number() over (partition by runner_id order by rn) as x from runs where rn <= 5) group by 1 having count(*) >= 2),
more as (select r.runner_id, any_value(r.race_id) as race_id, floor((any_value(epoch_us(r.race_ts)) - max(epoch_us(h.race_ts)) filter (rn = 1)) / 86400000000) as days, count(h.runner_id) as n,
    count(*) filter (rn <= 5 and (h.finishing_position <= 3 or h.beaten <= 5)) as close_finishes, any_value(r.distance_f) - max(h.distance_f) filter (rn = 1) as distance_change,
    max(h.official_rating) filter (abs(h.distance_f - h.furthest) <= 1.5) as near_rating, any_value(r.distance_f) > 1.25 * max(h.furthest) as beyond,
    median(h.t) as t_median, case when count(h.t) >= 2 then stddev_pop(h.t) end as t_dev, avg(h.speed) as speed_mean,
    count(*) filter (h.t > 0.02 and h.l >= -0.02)::double / nullif(count(*) filter (h.t is not null and h.l is not null), 0) as sustaining, count(*) filter (h.t > 0.02 and h.l < -0.02)::double / nullif(count(*) filter (h.t is not null and h.l is not null), 0) as weakening,
    count(*) filter (h.headgear = own_headgear) as geared
  from runners r left join runs h on h.runner_id = r.runner_id group by r.runner_id)"""

_GROUPS_SQL = {
    "form": ("current_form", ["career_runs_to_date", "first_time_out_flag", "form_last_run_position", "form_avg_position_last3", "form_avg_position_last5", "form_recency_weighted_percentile", "form_or_relative_recent", "form_consistency", *[f"form_{x}_last{k}" for x in ("wins", "places") for k in (3, 5, 10)]]),
    "slopes": ("form_slopes", ["form_improvement_slope", "avg_days_between_runs"]),
    "marks": ("rating_history", features.GROUPS["rating"][7:]),
    "classes": ("class_record", features.GROUPS["class"]),
    "records": ("course_distance_going", [k for k in features.GROUPS["course_distance_going"] if k not in ("distance_change_furlongs", "best_recent_or_near_distance", "stamina_uncertainty_flag", "going_similarity_score", "going_change_flag")]),
    "goings": ("going_similarity", ["going_similarity_score", "going_change_flag"]),
    "draws": ("draw_percentile", ["field_size", "draw_number", "draw_percentile", "draw_bucket_low", "draw_bucket_mid", "draw_bucket_high"]),
    "gear": ("headgear_trainer_change", features.GROUPS["headgear_changes"][4:]),
    "ages": ("age_experience", [k for k in features.GROUPS["age_experience"] if k != "exposed_horse_flag"]),
    "evidences": ("evidence_density", features.GROUPS["evidence"]),
    "paces": ("pace_history", ["pace_features_available", "avg_early_position_percentile", "early_position_consistency", "prob_competing_for_lead", "slow_start_frequency", "fast_start_frequency", "transition_change_3f_to_2f", "transition_change_2f_to_1f", "avg_transition_gain", "pct_gaining_in_transition", "pct_losing_in_transition", "late_position_change_1f_to_finish", "late_fade_frequency", "late_gain_frequency"]),
}
_RENAMED_SQL = {
    "ratings": ("rating_vs_field", {"percentile_in_field": "or_percentile_in_field", "diff_to_field_mean": "or_diff_to_field_mean", "diff_to_field_top": "or_diff_to_top_rated"}),
    "weights": ("weight_vs_field", {"percentile_in_field": "weight_percentile_in_field", "diff_to_field_mean": "weight_diff_from_field_mean", "diff_to_field_top": "weight_diff_to_top_weight"}),
    "bias": ("draw_bias", {"sample_size": "draw_bias_sample_size", "draw_bias_win_rate": "draw_bias_win_rate", "draw_bias_available": "draw_bias_available"}),
    "trainers": ("trainer_rolling_14_30", {"runs_14d": "trainer_runs_14d", "runs_30d": "trainer_runs_30d", "strike_rate_14d": "trainer_strike_rate_14d", "strike_rate_30d": "trainer_strike_rate_30d", "place_rate_30d": "trainer_place_rate_30d"}),
    "jockeys": ("jockey_rolling_14_30", {"runs_14d": "jockey_runs_14d", "runs_30d": "jockey_runs_30d", "strike_rate_14d": "jockey_strike_rate_14d", "strike_rate_30d": "jockey_strike_rate_30d"}),
    "combos": ("combo_course_rates", {"trainer_course_rate": "trainer_course_rate", "trainer_course_runs": "trainer_course_runs", "jockey_course_rate": "jockey_course_rate", "jockey_course_runs": "jockey_course_runs", "trainer_jockey_rate": "trainer_jockey_combo_rate", "trainer_jockey_runs": "trainer_jockey_combo_runs"}),
    "shapes": ("race_shape", {"leaders": "race_expected_leaders", "prominent": "race_expected_prominent", "holdup": "race_expected_holdup", "pressure": "race_pace_pressure_estimate", "collapse_risk": "race_pace_collapse_risk", "prominent_in_burnout_risk": "prominent_in_burnout_risk", "holdup_in_weak_pace_penalty": "holdup_in_weak_pace_penalty", "closer_in_strong_pace_boost": "closer_in_strong_pace_boost"}),
}
_MORE_SQL = {
    "days_since_last_run": "days", "quick_turnaround_flag": "(days < 10)::bigint", "long_layoff_flag": "(days > 180)::bigint", "form_beaten_distance_trend": "round(beaten_trend, 9)", "form_topspeed_trend": "round(speed_trend, 9)", "form_competitive_finishes_last5": "case when n > 0 then close_finishes end",
    "handicap_flag": "(roles.race_id % 2 = 0)::bigint", "penalty_lbs": "0.0::double", "penalty_lbs_available": "0::bigint", "official_rating": "roles.official_rating",
    "jockey_claim_lbs": "coalesce(claim, 0)", "weight_for_age_allowance": "0.0::double", "weight_for_age_allowance_available": "0::bigint", "weight_carried_lbs": "weight_lbs", "effective_weight_after_claim": "weight_lbs - coalesce(claim, 0)", "age_weight_interaction": "round(age * w_mean, 9)",
    "distance_change_furlongs": "round(distance_change, 9)", "best_recent_or_near_distance": "near_rating", "stamina_uncertainty_flag": "case when n > 0 then coalesce(beyond, true)::bigint end",
    "draw_x_leader_style": "round((1 - case when roles.field_size > 1 then q end) * (role in ('LEADER', 'PRONOUNCED_PACE'))::int, 9)",
    **{f"usual_running_style_{k}": f"(role = '{v}')::bigint" for k, v in (("leader", "LEADER"), ("prominent", "PRONOUNCED_PACE"), ("midfield", "MIDDIVISION"), ("holdup", "HOLD_UP"))},
    "median_transition_gain": "round(t_median, 9)", "transition_consistency": "round(t_dev, 9)", "avg_final_furlong_relative_gain": "late_position_change_1f_to_finish", "late_finishing_speed_pct": "round(speed_mean, 9)", "pct_sustaining_transition": "round(sustaining, 9)", "pct_weakening_after_move": "round(weakening, 9)",
    "style_vs_projected_pace_mismatch": "prominent_in_burnout_risk", "wind_surgery_flag": "0::bigint", "wind_surgery_flag_available": "0::bigint", "first_time_headgear_flag": "(roles.headgear is not null and geared = 0)::bigint", "repeated_headgear_flag": "(roles.headgear is not null and geared > 0)::bigint", "exposed_horse_flag": "(n >= 10)::bigint",
    **{"win_target": "coalesce((finishing_position = 1)::bigint, 0)"}, **{f"place_{k}_target": f"coalesce((finishing_position <= {k})::bigint, 0)" for k in range(2, 7)},
}


def _training_sql() -> str:
    parts = {a: (f"({ORACLE_SQL[q]})", {k: k for k in keys}) for a, (q, keys) in _GROUPS_SQL.items()} | {a: (f"({ORACLE_SQL[q]})", names) for a, (q, names) in _RENAMED_SQL.items()}
    columns = [f"{a}.{new} as {new}" for a, (_, names) in parts.items() for new in names.values()]
    joins = " ".join(f"join (select runner_id as {a}_id, {', '.join(f'{old} as {new}' for old, new in names.items())} from {sql}) {a} on {a}_id = roles.runner_id" for a, (sql, names) in parts.items())
    return f"with {HISTORY_SQL}, {_PAST} select roles.runner_id as runner_id, roles.race_id as race_id, {', '.join(columns)}, {', '.join(f'{v} as {k}' for k, v in _MORE_SQL.items())} from roles join more on more.runner_id = roles.runner_id left join b5 on b5.runner_id = roles.runner_id left join s5 on s5.runner_id = roles.runner_id {joins}"


#: Lines of one task where careers are followed: rows are wide there.
_CAREER_LINES = 100_000


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and targets of all runners."""
    runners = racing.with_form(racing.runners(spark, sf_dir))
    table = features.feature_table(runners, ("runner_id", "race_id", "finishing_position"), racing.parts(spark, sf_dir, each=_CAREER_LINES))
    return table.select("runner_id", "race_id", *[c.alias(k) for k, c in features.targets(F.col("finishing_position")).items()], *features.KEYS)


@query(_training_sql())
def training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature keys and targets, one row per runner."""
    return tidy(training_rows(spark, sf_dir))
