"""DuckDB definitions of the domain views, for the oracle SQL.

Each entry is the body of a CTE; :func:`with_views` emits the needed CTEs in
dependency order. Double literals are written as ``::DOUBLE`` so DuckDB does
not switch to DECIMAL arithmetic.
"""

from __future__ import annotations

_DEPS = {
    "visits": (),
    "visits_gappy": ("visits",),
    "facility_visits": (),
    "staffing": (),
    "stays": (),
    "scored": ("visits",),
    "importance": ("visits", "scored"),
    "comparison": ("visits", "scored"),
}

SPLIT_SQL = ("CASE WHEN ('0x' || substr(md5(CAST({id} AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 "
             "THEN 'test' ELSE 'train' END")

FOLD_SQL = "CAST(('0x' || substr(md5('fold' || CAST({id} AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER)"

_FEATURES = ("nurse_staff_ratio", "specialist_availability", "facility_beds",
             "patient_load", "triage_time_min", "registration_time_min",
             "visit_hour", "urgency_priority")

_BODIES = {
    "visits": """
  SELECT event_id AS visit_id, user_id AS patient_id, ts AS visit_ts, event_type,
         value AS wait_min,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS patient_load,
         CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High'
              WHEN 'signup' THEN 'Medium' WHEN 'click' THEN 'Low' END AS urgency_level,
         CASE user_id % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East'
              WHEN 3 THEN 'West' ELSE 'Central' END AS region,
         user_id % 7 + 1 AS specialist_availability,
         CAST(CASE user_id % 4 WHEN 0 THEN 150 WHEN 1 THEN 200 WHEN 2 THEN 300 ELSE 500 END AS BIGINT)
              AS facility_beds,
         0.15::DOUBLE + (event_id % 21) / 100.0::DOUBLE AS nurse_staff_ratio,
         value * 0.3::DOUBLE + (event_id % 5) AS triage_time_min,
         value * 0.05::DOUBLE + (event_id % 9) AS registration_time_min,
         CAST(hour(ts) AS INTEGER) AS visit_hour,
         CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3
              WHEN 'error' THEN 4 ELSE 2 END AS urgency_priority
  FROM events""",
    "visits_gappy": """
  SELECT * REPLACE (
      CASE WHEN visit_id % 10 = 0 THEN NULL ELSE wait_min END AS wait_min,
      CASE WHEN visit_id % 7 = 0 THEN NULL ELSE urgency_level END AS urgency_level,
      CASE WHEN visit_id % 6 = 0 THEN NULL ELSE patient_load END AS patient_load)
  FROM visits""",
    "facility_visits": """
  SELECT o_orderkey AS visit_id, o_custkey AS patient_id, r_name AS region, n_name AS nation,
         o_orderdate AS visit_ts, o_totalprice AS cost, c_mktsegment AS segment,
         o_orderpriority AS priority, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
    "staffing": """
  SELECT l_orderkey * 10 + l_linenumber AS staff_id, p_type AS department,
         l_quantity AS shift_hours, l_quantity * l_tax AS overtime_hours,
         CAST(l_linenumber + s_nationkey AS BIGINT) AS patient_load,
         l_suppkey % 6 AS absenteeism_days, CAST(p_size AS DOUBLE) AS years_experience,
         p_retailprice / 100.0::DOUBLE AS satisfaction_score,
         p_retailprice / 110.0::DOUBLE AS previous_satisfaction
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "stays": """
  SELECT l_orderkey * 10 + l_linenumber AS stay_id,
         CASE WHEN CAST(floor(l_quantity * 2.6::DOUBLE) AS BIGINT) >= 120 THEN '120 +'
              ELSE CAST(CAST(floor(l_quantity * 2.6::DOUBLE) AS BIGINT) AS VARCHAR) END AS length_of_stay,
         CASE l_returnflag WHEN 'A' THEN 'Expired' WHEN 'R' THEN 'Home' END AS disposition,
         l_linestatus AS admission_type,
         CASE l_partkey % 5 WHEN 0 THEN '0 to 17' WHEN 1 THEN '18 to 29' WHEN 2 THEN '30 to 49'
              WHEN 3 THEN '50 to 69' ELSE '70 or Older' END AS age_group,
         CASE l_suppkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'F' ELSE 'M' END AS gender,
         CASE l_linenumber % 5 WHEN 1 THEN 'Minor' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Major'
              WHEN 4 THEN 'Extreme' END AS risk_of_mortality,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_suppkey END AS facility_id,
         l_extendedprice AS total_charges
  FROM lineitem""",
    "scored": """
  SELECT v.visit_id AS id, v.event_type AS dataset, 'wait_min' AS target,
         """ + SPLIT_SQL.format(id="v.visit_id") + """ AS split,
         v.wait_min AS y_true, v.urgency_level, v.region, v.nurse_staff_ratio, v.specialist_availability,
         v.facility_beds, v.patient_load, v.triage_time_min, v.registration_time_min,
         v.visit_hour, v.urgency_priority, m.model,
         CASE m.model
              WHEN 'a' THEN 0.85::DOUBLE * v.wait_min + (v.visit_id % 23) - 6
              WHEN 'b' THEN 0.6::DOUBLE * v.wait_min + (v.visit_id % 11) + 10
              WHEN 'c' THEN avg(v.wait_min) OVER (PARTITION BY v.event_type)
              ELSE v.wait_min - 25 + (v.visit_id % 5) END AS y_pred
  FROM visits v, (VALUES ('a'), ('b'), ('c'), ('d')) m(model)""",
    "importance": """
  SELECT model, feature, round(raw / sum(raw) OVER (PARTITION BY model), 9) AS score
  FROM (""" + "\n    UNION ALL ".join(
        f"SELECT model, '{f}' AS feature, coalesce(abs(corr(CAST({f} AS DOUBLE), y_pred)), 0.0) AS raw "
        f"FROM scored GROUP BY model" for f in _FEATURES) + """
  ) w""",
    "comparison": """
  SELECT 'session_1' AS session, g.dataset, 'wait_min' AS target, g.model,
         round(1 - tmse / nullif(tvy, 0), 6) AS test_r2, round(sqrt(tmse), 6) AS test_rmse,
         round(tmae, 6) AS test_mae, round(greatest(cv.cv_score, 1e-5::DOUBLE), 6) AS cv_score,
         round(cv.cv_std, 6) AS cv_std, CAST(NULL AS DOUBLE) AS training_time,
         round((1 - rmse_ / nullif(rvy, 0)) - (1 - tmse / nullif(tvy, 0)), 6) AS overfitting
  FROM (SELECT dataset, model,
               avg(CASE WHEN split = 'test' THEN (y_true - y_pred) * (y_true - y_pred) END) AS tmse,
               avg(CASE WHEN split = 'test' THEN abs(y_true - y_pred) END) AS tmae,
               var_pop(CASE WHEN split = 'test' THEN y_true END) AS tvy,
               avg(CASE WHEN split = 'train' THEN (y_true - y_pred) * (y_true - y_pred) END) AS rmse_,
               var_pop(CASE WHEN split = 'train' THEN y_true END) AS rvy
        FROM scored GROUP BY dataset, model) g
  LEFT JOIN (SELECT dataset, model, avg(r2) AS cv_score, stddev_pop(r2) AS cv_std
             FROM (SELECT dataset, model, fold, 1 - avg(e * e) / nullif(var_pop(y_true), 0) AS r2
                   FROM (SELECT dataset, model, y_true, y_true - y_pred AS e,
                                """ + FOLD_SQL.format(id="id") + """ AS fold
                         FROM scored WHERE split = 'train') f
                   GROUP BY dataset, model, fold) x
             GROUP BY dataset, model) cv USING (dataset, model)""",
}


def _order(names):
    seen: list[str] = []

    def visit(n):
        for d in _DEPS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause defining the named views (and their dependencies).
    ``extra`` appends further CTE definitions (text after a comma)."""
    parts = [f"{n} AS ({_BODIES[n]}\n)" for n in _order(names) if n in _BODIES]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def register(name: str, body: str, deps=()) -> None:
    """Add a derived view body (used by operator modules)."""
    _BODIES[name] = body
    _DEPS[name] = tuple(deps)
