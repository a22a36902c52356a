"""Queries for projections/filters (C), feature functions (D) and outliers (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.functions.stats import eps_div
from wardstats.operators import outliers as E
from wardstats.operators import transform as D
from wardstats.operators.evaluate import split_assign as split_op
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import SPLIT_SQL, with_views

_VIS_NO_ID = ("visit_ts, event_type, wait_min, patient_load, urgency_level, region, specialist_availability, "
              "facility_beds, nurse_staff_ratio, triage_time_min, registration_time_min, visit_hour, urgency_priority")


@query("drop_id_columns", with_views("visits_gappy") + f"SELECT {_VIS_NO_ID} FROM visits_gappy")
def drop_id_columns(spark, sf):
    return D.drop_id_columns(V.visits_gappy(spark, sf), target="wait_min")


@query("feature_subset", with_views("visits") + """
SELECT visit_id, patient_id, visit_ts, event_type, patient_load, urgency_level, region, specialist_availability,
       facility_beds, nurse_staff_ratio FROM visits""")
def feature_subset(spark, sf):
    return D.feature_subset(V.visits(spark, sf), exclude=("wait_min",))


@query("filter_keep_nulls", with_views("stays") + """
SELECT * FROM stays WHERE disposition IS DISTINCT FROM 'Expired'""")
def filter_keep_nulls(spark, sf):
    return D.filter_keep_nulls(V.stays(spark, sf), "disposition", "Expired")


@query("dropna_subset", with_views("stays") + """
SELECT * FROM stays WHERE facility_id IS NOT NULL AND disposition IS NOT NULL""")
def dropna_subset(spark, sf):
    return D.dropna_subset(V.stays(spark, sf), ["facility_id", "disposition"])


_LOS_INT = "CAST(CASE WHEN length_of_stay = '120 +' THEN '120' ELSE length_of_stay END AS INTEGER)"


@query("replace_and_cast", with_views("stays") + f"""
SELECT stay_id, {_LOS_INT} AS length_of_stay FROM stays""")
def replace_and_cast(spark, sf):
    return D.replace_and_cast(V.stays(spark, sf).select("stay_id", "length_of_stay"), "length_of_stay")


@query("date_features", with_views("visits") + """
SELECT visit_id, CAST(hour(visit_ts) AS INTEGER) AS visit_ts_hour,
       CAST(isodow(visit_ts) - 1 AS INTEGER) AS visit_ts_day_of_week, CAST(month(visit_ts) AS INTEGER) AS visit_ts_month,
       CAST(quarter(visit_ts) AS INTEGER) AS visit_ts_quarter,
       CAST(CASE WHEN isodow(visit_ts) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS visit_ts_is_weekend,
       CAST(isodow(visit_ts) - 1 >= 5 AS BOOLEAN) AS weekend_by_name
FROM visits""")
def date_features(spark, sf):
    v = V.visits(spark, sf).select("visit_id", "visit_ts")
    v = v.withColumn("_day", F.date_format("visit_ts", "EEEE"))
    out = D.date_features(v.withColumn("weekend_by_name", D.is_weekend_name("_day")), ["visit_ts"])
    return out.drop("_day")


@query("ratio_features", with_views("visits") + """
SELECT visit_id, nurse_staff_ratio / (specialist_availability + 1e-6::DOUBLE) AS staff_efficiency_ratio,
       facility_beds / (specialist_availability + 1e-6::DOUBLE) AS beds_per_specialist,
       nurse_staff_ratio AS patients_per_nurse,
       facility_beds / (specialist_availability + 1e-5::DOUBLE) AS beds_per_specialist_nb
FROM visits""")
def ratio_features(spark, sf):
    v = V.visits(spark, sf).select("visit_id", "nurse_staff_ratio", "specialist_availability", "facility_beds")
    out = D.ratio_features(v, "nurse_staff_ratio", "specialist_availability", "facility_beds")
    # the notebook variant uses ε = 1e-5
    out = out.withColumn("beds_per_specialist_nb", eps_div("facility_beds", "specialist_availability", 1e-5))
    return out.select("visit_id", "staff_efficiency_ratio", "beds_per_specialist", "patients_per_nurse",
                      "beds_per_specialist_nb")


@query("pairwise_ratios", with_views("visits") + """
SELECT visit_id, triage_time_min / (registration_time_min + 1e-6::DOUBLE) AS triage_time_min_to_registration_time_min_ratio
FROM visits""")
def pairwise_ratios(spark, sf):
    v = V.visits(spark, sf).select("visit_id", "wait_min", "triage_time_min", "registration_time_min")
    return D.pairwise_ratios(v, exclude=("wait_min",)).drop("wait_min", "triage_time_min", "registration_time_min")


@query("capacity_utilization", with_views("visits") + """
SELECT event_type, patient_load, facility_beds, CAST(patient_load AS DOUBLE) / nullif(facility_beds, 0)
       AS capacity_utilization FROM visits""")
def capacity_utilization(spark, sf):
    v = D.drop_id_columns(V.visits(spark, sf)).select("event_type", "patient_load", "facility_beds")
    return D.capacity_utilization(v, "facility_beds")


@query("urgency_numeric", with_views("visits_gappy") + """
SELECT visit_id, urgency_level, CASE urgency_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3
       WHEN 'Critical' THEN 4 ELSE 2 END AS urgency_numeric FROM visits_gappy""")
def urgency_numeric(spark, sf):
    return D.urgency_numeric(V.visits_gappy(spark, sf).select("visit_id", "urgency_level"))


@query("ordinal_maps", with_views("stays") + """
SELECT stay_id,
       CASE age_group WHEN '0 to 17' THEN 1 WHEN '18 to 29' THEN 2 WHEN '30 to 49' THEN 3 WHEN '50 to 69' THEN 4
            WHEN '70 or Older' THEN 5 ELSE 0 END AS age_group,
       CASE gender WHEN 'U' THEN 0 WHEN 'F' THEN 1 WHEN 'M' THEN 2 ELSE 0 END AS gender,
       CASE risk_of_mortality WHEN 'Minor' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Major' THEN 3 WHEN 'Extreme' THEN 4
            ELSE 0 END AS risk_of_mortality
FROM stays""")
def ordinal_maps(spark, sf):
    s = V.stays(spark, sf).select("stay_id", "age_group", "gender", "risk_of_mortality")
    return D.ordinal_maps(s, "age_group", "gender", "risk_of_mortality")


@query("group_complexity", with_views("visits") + """,
g AS (SELECT region, coalesce(stddev_samp(wait_min), 0.0) AS region_complexity FROM visits GROUP BY region)
SELECT visit_id, region, round(region_complexity, 6) AS region_complexity FROM visits JOIN g USING (region)""")
def group_complexity(spark, sf):
    v = V.visits(spark, sf).select("visit_id", "region", "wait_min")
    out = D.group_complexity(v, "wait_min", ["region"])
    return out.select("visit_id", "region", F.round("region_complexity", 6).alias("region_complexity"))


@query("group_complexity_cost", with_views("facility_visits") + """,
g AS (SELECT region, coalesce(stddev_samp(cost), 0.0) AS region_complexity FROM facility_visits GROUP BY region)
SELECT visit_id, region, round(region_complexity, 6) AS region_complexity FROM facility_visits JOIN g USING (region)""")
def group_complexity_cost(spark, sf):
    """D9 on the order-derived visits: cost complexity of the customer's region."""
    v = V.facility_visits(spark, sf).select("visit_id", "region", "cost")
    out = D.group_complexity(v, "cost", ["region"])
    return out.select("visit_id", "region", F.round("region_complexity", 6).alias("region_complexity"))


@query("staff_features", with_views("staffing") + """
SELECT staff_id, overtime_hours / (shift_hours + 1e-5::DOUBLE) AS overtime_ratio,
       CASE WHEN years_experience > 0 AND years_experience <= 5 THEN 'Novice'
            WHEN years_experience > 5 AND years_experience <= 10 THEN 'Intermediate'
            WHEN years_experience > 10 AND years_experience <= 20 THEN 'Experienced'
            WHEN years_experience > 20 THEN 'Veteran' END AS experience_level,
       satisfaction_score - previous_satisfaction AS satisfaction_change
FROM staffing""")
def staff_features(spark, sf):
    s = V.staffing(spark, sf)
    out = D.staff_features(s, "overtime_hours", "shift_hours", "years_experience", "satisfaction_score",
                           "previous_satisfaction")
    return out.select("staff_id", "overtime_ratio", "experience_level", "satisfaction_change")


@query("los_bins", with_views("stays") + f""",
l AS (SELECT stay_id, {_LOS_INT} AS los FROM stays)
SELECT stay_id, los AS length_of_stay,
       CASE WHEN los > 0 AND los <= 5 THEN '(0- 5]' WHEN los > 5 AND los <= 10 THEN '(5- 10]'
            WHEN los > 10 AND los <= 20 THEN '(10- 20]' WHEN los > 20 AND los <= 30 THEN '(20- 30]'
            WHEN los > 30 AND los <= 50 THEN '(30- 50]' WHEN los > 50 AND los <= 120 THEN '(50- 120+]'
            ELSE 'nan' END AS los_bin,
       CASE WHEN los > 0 AND los <= 5 THEN 5 WHEN los > 5 AND los <= 10 THEN 10 WHEN los > 10 AND los <= 20 THEN 20
            WHEN los > 20 AND los <= 30 THEN 30 WHEN los > 30 AND los <= 50 THEN 50
            WHEN los > 50 AND los <= 120 THEN 120 END AS los_label
FROM l""")
def los_bins(spark, sf):
    s = D.replace_and_cast(V.stays(spark, sf).select("stay_id", "length_of_stay"), "length_of_stay")
    return D.los_bins(s, "length_of_stay")


# ---------------------------------------------------------------- outliers

_OUT_COLS = ["wait_min", "patient_load", "triage_time_min", "registration_time_min"]


def _iqr_sql(cols, src="visits", t=1.5):
    st = ", ".join(
        f"round(quantile_cont({c}, 0.25) - {t}::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS lo_{c}, "
        f"round(quantile_cont({c}, 0.75) + {t}::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS hi_{c}"
        for c in cols)
    flag = " OR ".join(f"coalesce({c} < lo_{c} OR {c} > hi_{c}, false)" for c in cols)
    return st, flag


_IQR_ST, _IQR_FLAG = _iqr_sql(_OUT_COLS)


@query("outliers_iqr", with_views("visits") + f""",
st AS (SELECT {_IQR_ST} FROM visits)
SELECT visit_id, {_IQR_FLAG} AS is_outlier FROM visits, st""")
def outliers_iqr(spark, sf):
    v = V.visits(spark, sf).select("visit_id", *_OUT_COLS)
    return E.outlier_flag(v, "iqr", 1.5, _OUT_COLS).select("visit_id", "is_outlier")


_Z_ST = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _OUT_COLS)
_Z_FLAG = " OR ".join(f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3, false)" for c in _OUT_COLS)


@query("outliers_zscore", with_views("visits") + f""",
st AS (SELECT {_Z_ST} FROM visits)
SELECT visit_id, {_Z_FLAG} AS is_outlier FROM visits, st""")
def outliers_zscore(spark, sf):
    v = V.visits(spark, sf).select("visit_id", *_OUT_COLS)
    return E.outlier_flag(v, "zscore", 3.0, _OUT_COLS).select("visit_id", "is_outlier")


_G_COLS = ["wait_min", "patient_load"]
_G_ST, _G_FLAG = _iqr_sql(_G_COLS)


@query("outliers_guarded", with_views("visits") + f""",
st AS (SELECT {_G_ST} FROM visits),
f AS (SELECT visit_id, {_G_FLAG} AS o FROM visits, st),
s AS (SELECT sum(CASE WHEN o THEN 1 ELSE 0 END) AS nf, count(*) AS n FROM f)
SELECT visit_id FROM f, s WHERE NOT (nf > 0 AND nf < n * 0.1 AND o)""")
def outliers_guarded(spark, sf):
    v = V.visits(spark, sf).select("visit_id", *_G_COLS)
    return E.guarded_removal(v, "iqr", 1.5, _G_COLS).select("visit_id")


_T_ST, _T_FLAG = _iqr_sql(_G_COLS, "tr")


@query("outliers_train_only", with_views("visits") + f""",
sp AS (SELECT visit_id, wait_min, patient_load, {SPLIT_SQL.format(id="visit_id")} AS split FROM visits),
tr AS (SELECT * FROM sp WHERE split = 'train'),
st AS (SELECT {_T_ST} FROM tr),
f AS (SELECT visit_id, split, {_T_FLAG} AS o FROM tr, st),
s AS (SELECT sum(CASE WHEN o THEN 1 ELSE 0 END) AS nf, count(*) AS n FROM f)
SELECT visit_id, split FROM f, s WHERE NOT (nf > 0 AND nf < n * 0.1 AND o)
UNION ALL SELECT visit_id, split FROM sp WHERE split <> 'train'""")
def outliers_train_only(spark, sf):
    v = split_op(V.visits(spark, sf).select("visit_id", *_G_COLS), "visit_id")
    return E.remove_outliers_train_only(v, cols=_G_COLS).select("visit_id", "split")
