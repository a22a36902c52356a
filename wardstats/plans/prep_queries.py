"""Queries for imputation, scaling, encoding, selection and the full
preprocess (F1-F15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.operators import prep as P
from wardstats.operators import transform as D
from wardstats.operators.evaluate import split_assign
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.sources.tables import read_table
from wardstats.plans.sqlviews import SPLIT_SQL, with_views

GAPPY = with_views("visits_gappy")
ROLES = P.Roles(nurse="nurse_staff_ratio", specialists="specialist_availability", beds="facility_beds",
                urgency="urgency_level")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (stable comparison of feature matrices)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


@query("impute_mean", GAPPY + """
SELECT visit_id, round(coalesce(wait_min, (SELECT avg(wait_min) FROM visits_gappy)), 6) AS wait_min,
       round(coalesce(CAST(patient_load AS DOUBLE), (SELECT avg(patient_load) FROM visits_gappy)), 6) AS patient_load
FROM visits_gappy""")
def impute_mean(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", "wait_min", "patient_load")
    return round_doubles(P.impute(v, ["wait_min", "patient_load"], "mean"))


@query("impute_median", GAPPY + """
SELECT visit_id, round(coalesce(wait_min, (SELECT quantile_cont(wait_min, 0.5) FROM visits_gappy)), 6) AS wait_min,
       round(coalesce(CAST(patient_load AS DOUBLE), (SELECT quantile_cont(patient_load, 0.5) FROM visits_gappy)), 6)
           AS patient_load
FROM visits_gappy""")
def impute_median(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", "wait_min", "patient_load")
    return round_doubles(P.impute(v, ["wait_min", "patient_load"], "median"))


@query("impute_mode", GAPPY + """
SELECT visit_id,
       coalesce(urgency_level, (SELECT urgency_level FROM visits_gappy WHERE urgency_level IS NOT NULL
                                GROUP BY urgency_level ORDER BY count(*) DESC, urgency_level LIMIT 1)) AS urgency_level,
       coalesce(patient_load, (SELECT patient_load FROM visits_gappy WHERE patient_load IS NOT NULL
                               GROUP BY patient_load ORDER BY count(*) DESC, patient_load LIMIT 1)) AS patient_load
FROM visits_gappy""")
def impute_mode(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", "urgency_level", "patient_load")
    return P.impute(v, ["urgency_level", "patient_load"], "mode")


@query("forward_fill", GAPPY + """
SELECT visit_id, patient_id, visit_ts,
       last_value(wait_min IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait_min,
       last_value(urgency_level IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_id
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS urgency_level
FROM visits_gappy""")
def forward_fill(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", "patient_id", "visit_ts", "wait_min", "urgency_level")
    return P.forward_fill(v, ["wait_min", "urgency_level"], key="patient_id", ts="visit_ts", tie="visit_id")


@query("standard_scale", with_views("visits") + """
SELECT visit_id,
       round((wait_min - (SELECT avg(wait_min) FROM visits)) / (SELECT stddev_pop(wait_min) FROM visits), 6) AS wait_min,
       round((triage_time_min - (SELECT avg(triage_time_min) FROM visits))
             / (SELECT stddev_pop(triage_time_min) FROM visits), 6) AS triage_time_min
FROM visits""")
def standard_scale(spark, sf):
    v = V.visits(spark, sf).select("visit_id", "wait_min", "triage_time_min")
    return round_doubles(P.standard_scale(v, ["wait_min", "triage_time_min"]))


@query("scale_train_test", with_views("visits") + f""",
s AS (SELECT visit_id, wait_min, triage_time_min, {SPLIT_SQL.format(id="visit_id")} AS split FROM visits),
p AS (SELECT avg(wait_min) AS m1, stddev_pop(wait_min) AS s1, avg(triage_time_min) AS m2,
             stddev_pop(triage_time_min) AS s2 FROM s WHERE split = 'train')
SELECT visit_id, split, round((wait_min - m1) / s1, 6) AS wait_min, round((triage_time_min - m2) / s2, 6) AS triage_time_min
FROM s, p""")
def scale_train_test(spark, sf):
    v = split_assign(V.visits(spark, sf).select("visit_id", "wait_min", "triage_time_min"), "visit_id")
    out = P.standard_scale(v, ["wait_min", "triage_time_min"], fit_df=v.filter(F.col("split") == "train"))
    return round_doubles(out)


@query("one_hot", GAPPY + """
SELECT visit_id,
       CASE WHEN region = 'East' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_East,
       CASE WHEN region = 'North' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_North,
       CASE WHEN region = 'South' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_South,
       CASE WHEN region = 'West' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_West,
       CASE WHEN urgency_level = 'High' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urgency_level_High,
       CASE WHEN urgency_level = 'Low' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urgency_level_Low,
       CASE WHEN urgency_level = 'Medium' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urgency_level_Medium
FROM visits_gappy""")
def one_hot(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", "region", "urgency_level")
    return P.one_hot(v, ["region", "urgency_level"])


@query("one_hot_high_card", """
WITH codes AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 2 AS position FROM (SELECT DISTINCT c_name FROM customer)),
n AS (SELECT o_orderkey AS id, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT id, CAST(position AS BIGINT) AS position, value FROM n JOIN codes ON value = c_name WHERE position >= 0""")
def one_hot_high_card(spark, sf):
    names = read_table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("value"))
    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey").join(names, F.col("o_custkey") == F.col("c_custkey"))
    return P.one_hot_sparse(rows.select("id", "value"), "value", "id")


@query("ordinal_encode", with_views("stays") + """
SELECT stay_id,
       CAST(dense_rank() OVER (ORDER BY admission_type) - 1 AS DOUBLE) AS admission_type,
       CAST(dense_rank() OVER (ORDER BY gender) - 1 AS DOUBLE) AS gender,
       CASE WHEN risk_of_mortality IS NULL THEN NULL
            ELSE CAST(dense_rank() OVER (PARTITION BY risk_of_mortality IS NULL ORDER BY risk_of_mortality) - 1 AS DOUBLE)
       END AS risk_of_mortality
FROM stays""")
def ordinal_encode(spark, sf):
    s = V.stays(spark, sf).select("stay_id", "admission_type", "gender", "risk_of_mortality")
    return P.ordinal_encode(s, ["admission_type", "gender", "risk_of_mortality"])


_KB_FEATS = ["patient_load", "nurse_staff_ratio", "triage_time_min", "registration_time_min", "facility_beds",
             "specialist_availability", "visit_hour", "urgency_priority"]


@query("select_k_best", with_views("visits") + ", w AS (" + "\n UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr(CAST({f} AS DOUBLE), wait_min) AS r, count(*) AS n FROM visits" for f in _KB_FEATS)
       + """),
s AS (SELECT feature, r, round(r * r / (1 - r * r) * (n - 2), 9) AS f FROM w),
k AS (SELECT *, row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS position FROM s)
SELECT feature, round(r, 6) AS r, round(f, 6) AS f_score, CAST(position AS INTEGER) AS position,
       position <= 3 AS selected FROM k""")
def select_k_best(spark, sf):
    return P.select_k_best(V.visits(spark, sf), "wait_min", _KB_FEATS, 3)


@query("select_k_best_perfect", with_views("visits") + ", w AS (" + "\n UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr(CAST({x} AS DOUBLE), wait_min) AS r, count(*) AS n FROM visits"
    for f, x in (("doubled_wait", "wait_min * 2"), ("patient_load", "patient_load"), ("triage_time_min", "triage_time_min")))
       + """),
s AS (SELECT feature, r, CASE WHEN r * r >= 1 - 1e-12 THEN 'infinity'::DOUBLE ELSE r * r / (1 - r * r) * (n - 2) END AS f FROM w)
SELECT feature, round(r, 6) AS r, round(f, 6) AS f_score, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INTEGER) AS position,
       row_number() OVER (ORDER BY f DESC, feature) <= 1 AS selected FROM s""")
def select_k_best_perfect(spark, sf):
    v = V.visits(spark, sf).withColumn("doubled_wait", F.col("wait_min") * 2)
    return P.select_k_best(v, "wait_min", ["patient_load", "triage_time_min", "doubled_wait"], 1)


_NO_KEY = with_views("visits_gappy", extra="nk AS (SELECT * REPLACE (CASE WHEN patient_id % 5 <> 0 THEN patient_id END AS patient_id) FROM visits_gappy)")


@query("forward_fill_null_key", _NO_KEY + """
SELECT visit_id, patient_id, visit_ts,
       last_value(wait_min IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY visit_ts, visit_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait_min
FROM nk""")
def forward_fill_null_key(spark, sf):
    v = V.visits_gappy(spark, sf).select("visit_id", F.when(F.col("patient_id") % 5 != 0, F.col("patient_id")).alias("patient_id"), "visit_ts", "wait_min")
    return P.forward_fill(v, ["wait_min"], key="patient_id", ts="visit_ts", tie="visit_id")


# ---------------------------------------------------------------- column transformer

_ER_NUM = ["nurse_staff_ratio", "specialist_availability", "facility_beds", "triage_time_min",
           "registration_time_min", "visit_hour", "patient_load"]
_ER_CAT = ["region", "urgency_level", "event_type"]


def _ct_sql(src: str, key: str, nums, cats: dict, extra_cols=()) -> str:
    """ColumnTransformer oracle: mean impute → std₀ scale; mode → one-hot
    (categories given, first dropped)."""
    p1 = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS f_{c}" for c in nums)
    p2 = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), f_{c})) AS m_{c}, "
                   f"stddev_pop(coalesce(CAST({c} AS DOUBLE), f_{c})) AS s_{c}" for c in nums)
    modes = ", ".join(f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                      f" AS mode_{c}" for c in cats)
    num_cols = ", ".join(f"round((coalesce(CAST({c} AS DOUBLE), f_{c}) - m_{c}) / "
                         f"CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in nums)
    onehot = ", ".join(f"CASE WHEN coalesce({c}, mode_{c}) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\""
                       for c, vals in cats.items() for v in vals[1:])
    extra = "".join(f", {e}" for e in extra_cols)
    return f""", p1 AS (SELECT {p1} FROM {src}),
p2 AS (SELECT {p2} FROM {src}, p1),
md AS (SELECT {modes})
SELECT {key}, {num_cols}, {onehot}{extra} FROM {src}, p1, p2, md"""


@query("preprocess_er", GAPPY + _ct_sql("visits_gappy", "visit_id", _ER_NUM, {
    "region": ["Central", "East", "North", "South", "West"], "urgency_level": ["Critical", "High", "Low", "Medium"],
    "event_type": ["click", "error", "purchase", "signup", "view"]}, ["wait_min"]))
def preprocess_er(spark, sf):
    v = V.visits_gappy(spark, sf)
    return round_doubles(P.column_transform(v, _ER_NUM, _ER_CAT, keep=["visit_id"], target="wait_min"))


_ST_NUM = ["shift_hours", "overtime_hours", "patient_load", "absenteeism_days", "years_experience",
           "satisfaction_score", "previous_satisfaction", "overtime_ratio", "satisfaction_change"]


@query("preprocess_staff", with_views("staffing", extra="""sf AS (
  SELECT *, overtime_hours / (shift_hours + 1e-5::DOUBLE) AS overtime_ratio,
         CASE WHEN years_experience > 0 AND years_experience <= 5 THEN 'Novice'
              WHEN years_experience > 5 AND years_experience <= 10 THEN 'Intermediate'
              WHEN years_experience > 10 AND years_experience <= 20 THEN 'Experienced'
              WHEN years_experience > 20 THEN 'Veteran' END AS experience_level,
         satisfaction_score - previous_satisfaction AS satisfaction_change FROM staffing)""")
       + _ct_sql("sf", "staff_id", _ST_NUM, {
           "department": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
           "experience_level": ["Experienced", "Intermediate", "Novice", "Veteran"]}))
def preprocess_staff(spark, sf):
    s = D.staff_features(V.staffing(spark, sf), "overtime_hours", "shift_hours", "years_experience",
                         "satisfaction_score", "previous_satisfaction")
    return round_doubles(P.column_transform(s, _ST_NUM, ["department", "experience_level"], keep=["staff_id"]))


# ---------------------------------------------------------------- full preprocess

_FULL_NUM = ["patient_load", "nurse_staff_ratio", "triage_time_min", "registration_time_min", "visit_hour",
             "staff_efficiency_ratio", "beds_per_specialist", "triage_time_min_to_registration_time_min_ratio",
             "capacity_utilization"]
_FULL_CAT = ["event_type", "urgency_level", "region", "specialist_availability", "facility_beds", "urgency_priority",
             "visit_ts_hour", "visit_ts_day_of_week", "visit_ts_month", "visit_ts_quarter", "visit_ts_is_weekend",
             "urgency_numeric", "region_complexity"]


def _eng_sql(src: str) -> str:
    return f"""SELECT event_type, urgency_level, region, specialist_availability, facility_beds, nurse_staff_ratio,
         triage_time_min, registration_time_min, visit_hour, urgency_priority, patient_load, wait_min,
         CAST(hour(visit_ts) AS INTEGER) AS visit_ts_hour, CAST(isodow(visit_ts) - 1 AS INTEGER) AS visit_ts_day_of_week,
         CAST(month(visit_ts) AS INTEGER) AS visit_ts_month, CAST(quarter(visit_ts) AS INTEGER) AS visit_ts_quarter,
         CAST(CASE WHEN isodow(visit_ts) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS visit_ts_is_weekend,
         nurse_staff_ratio / (specialist_availability + 1e-6::DOUBLE) AS staff_efficiency_ratio,
         facility_beds / (specialist_availability + 1e-6::DOUBLE) AS beds_per_specialist,
         triage_time_min / (registration_time_min + 1e-6::DOUBLE) AS triage_time_min_to_registration_time_min_ratio,
         CAST(patient_load AS DOUBLE) / nullif(facility_beds, 0) AS capacity_utilization,
         CASE urgency_level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 ELSE 2 END
             AS urgency_numeric
  FROM {src}"""


def full_prep_sql(fit_src: str, apply_src: str, same: bool) -> str:
    """Independent DuckDB formulation of the full preprocess: engineer,
    guarded IQR removal on the fit rows, mean/std₀ of the imputed columns,
    modes and sorted categories, one-hot through a dynamic PIVOT."""
    flags = " OR ".join(f"coalesce({c} < lo_{c} OR {c} > hi_{c}, false)" for c in _FULL_NUM)
    fences = ", ".join(
        f"round(quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS lo_{c}, "
        f"round(quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 9) AS hi_{c}"
        for c in _FULL_NUM)
    p1 = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS f_{c}" for c in _FULL_NUM)
    p2 = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), f_{c})) AS m_{c}, "
                   f"stddev_pop(coalesce(CAST({c} AS DOUBLE), f_{c})) AS s_{c}" for c in _FULL_NUM)
    modes = ", ".join(f"(SELECT {c} FROM kept WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                      f" AS mode_{c}" for c in _FULL_CAT)
    cats = ",\n".join(
        f"cats_{c} AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM "
        f"(SELECT DISTINCT {c} AS v FROM kept WHERE {c} IS NOT NULL UNION SELECT mode_{c} FROM md))" for c in _FULL_CAT)
    long = "\n UNION ALL ".join(
        f"SELECT a.rid, '{c}_' || CAST(k.v AS VARCHAR) AS name, "
        f"CASE WHEN coalesce(a.{c}, md.mode_{c}) = k.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val "
        f"FROM app a, cats_{c} k, md WHERE k.pos > 1" for c in _FULL_CAT)
    num_cols = ", ".join(f"round((coalesce(CAST({c} AS DOUBLE), f_{c}) - m_{c}) / "
                         f"CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in _FULL_NUM)
    app = "SELECT row_number() OVER () AS rid, * FROM kept" if same else \
        f"SELECT row_number() OVER () AS rid, e.*, cx.region_complexity FROM ({_eng_sql(apply_src)}) e " \
        f"LEFT JOIN cx USING (region)"
    return f""",
fe AS ({_eng_sql(fit_src)}),
cx AS (SELECT region, round(coalesce(stddev_samp(wait_min), 0.0), 6) AS region_complexity FROM fe GROUP BY region),
fit_e AS (SELECT fe.*, cx.region_complexity FROM fe LEFT JOIN cx USING (region)),
fences AS (SELECT {fences} FROM fit_e),
flagged AS (SELECT fit_e.*, {flags} AS o FROM fit_e, fences),
share AS (SELECT sum(CASE WHEN o THEN 1 ELSE 0 END) AS nf, count(*) AS n FROM flagged),
kept AS (SELECT flagged.* EXCLUDE (o) FROM flagged, share WHERE NOT (nf > 0 AND nf < n * 0.1 AND o)),
p1 AS (SELECT {p1} FROM kept),
p2 AS (SELECT {p2} FROM kept, p1),
md AS (SELECT {modes}),
{cats},
app AS ({app}),
num AS (SELECT rid, {num_cols}, wait_min FROM app, p1, p2),
lg AS ({long})
"""


#: Numeric columns as they are; of the 0/1 columns (whose names depend on the
#: data) their number and the names of those that are 1.
FULL_FINAL = """
SELECT num.* EXCLUDE (rid), CAST((SELECT count(DISTINCT name) FROM lg) AS BIGINT) AS n_columns, coalesce(ones, '') AS ones
FROM num LEFT JOIN (SELECT rid, string_agg(name, ',' ORDER BY name) AS ones FROM lg WHERE val = 1 GROUP BY rid) o USING (rid)"""


def _ones(df: DataFrame, numeric) -> DataFrame:
    """The 0/1 columns as their number and the names of those that are 1."""
    hot = [c for c in df.columns if c not in numeric]
    # cut in runs: one expression of some hundred branches would not compile to one method
    runs = [F.filter(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in hot[a:a + 50]]), lambda x: x.isNotNull()) for a in range(0, len(hot), 50)]
    ones = F.concat_ws(",", F.array_sort(F.concat(*runs))) if runs else F.lit("")
    return df.select(*numeric, F.lit(len(hot)).cast("bigint").alias("n_columns"), ones.alias("ones"))


@query("preprocess_full", GAPPY + full_prep_sql("visits_gappy", "visits_gappy", True) + FULL_FINAL)
def preprocess_full(spark, sf):
    out, _ = P.fit_transform(V.visits_gappy(spark, sf), "wait_min", P.PrepOptions(), ROLES)
    return _ones(round_doubles(out), [*_FULL_NUM, "wait_min"])


_SPLIT_V = f"""sv AS (SELECT *, {SPLIT_SQL.format(id="visit_id")} AS split FROM visits_gappy),
train_v AS (SELECT * EXCLUDE (split) FROM sv WHERE split = 'train'),
test_v AS (SELECT * EXCLUDE (split) FROM sv WHERE split = 'test')"""


@query("preprocess_apply", with_views("visits_gappy", extra=_SPLIT_V) + full_prep_sql("train_v", "test_v", False) + FULL_FINAL)
def preprocess_apply(spark, sf):
    v = split_assign(V.visits_gappy(spark, sf), "visit_id")
    train = v.filter(F.col("split") == "train").drop("split")
    test = v.filter(F.col("split") == "test").drop("split")
    model = P.fit(train, "wait_min", P.PrepOptions(), ROLES)
    return _ones(round_doubles(model.apply(test)), [*_FULL_NUM, "wait_min"])


_WIDE_NUM = ["triage_time_min", "registration_time_min"]
_WIDE = with_views("visits_gappy", extra="""wide AS (
  SELECT visit_id AS row_no, CASE WHEN visit_id % 11 <> 0 THEN 'P' || CAST(patient_id AS VARCHAR) END AS patient,
         urgency_level, triage_time_min, registration_time_min, wait_min FROM visits_gappy)""")


def wide_visits(spark, sf):
    """Visits with the patient, of any number, as a category with gaps."""
    patient = F.when(F.col("visit_id") % 11 != 0, F.concat(F.lit("P"), F.col("patient_id").cast("string")))
    return V.visits_gappy(spark, sf).select(
        F.col("visit_id").alias("row_no"), patient.alias("patient"), "urgency_level", *_WIDE_NUM, "wait_min")


@query("preprocess_wide", _WIDE + _ct_sql("wide", "row_no", _WIDE_NUM, {"urgency_level": ["Critical", "High", "Low", "Medium"]}, [
    "(SELECT pos FROM (SELECT patient AS p, row_number() OVER (ORDER BY patient) - 2 AS pos FROM wide WHERE patient IS NOT NULL GROUP BY patient) "
    "WHERE p = coalesce(patient, (SELECT patient FROM wide WHERE patient IS NOT NULL GROUP BY patient ORDER BY count(*) DESC, patient LIMIT 1))) "
    "AS patient_position", "wait_min"]))
def preprocess_wide(spark, sf):
    v = wide_visits(spark, sf)
    options = P.PrepOptions(feature_engineering=False, outlier_detection=False)
    return round_doubles(P.fit(v.drop("row_no"), "wait_min", options).apply(v, keep=["row_no"]))


@query("preprocess_summary", GAPPY + full_prep_sql("visits_gappy", "visits_gappy", True) + f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM visits_gappy) AS rows_before,
       (SELECT CAST(count(*) AS BIGINT) FROM num) AS rows_after, 15 AS columns_before,
       CAST((SELECT count(DISTINCT name) FROM lg) + {len(_FULL_NUM) + 1} AS INTEGER) AS columns_after""")
def preprocess_summary(spark, sf):
    v = V.visits_gappy(spark, sf)
    out, _ = P.fit_transform(v, "wait_min", P.PrepOptions(), ROLES)
    return P.preprocess_summary(v, out)
