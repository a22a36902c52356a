"""Queries for profiling (B1-B21) and schema-level projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.operators import profile as B
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views

# Column types of the `visits` / `visits_gappy` views (Spark simple strings).
VISIT_TYPES = (("visit_id", "bigint"), ("patient_id", "bigint"), ("visit_ts", "timestamp_ntz"),
               ("event_type", "string"), ("wait_min", "double"), ("patient_load", "int"),
               ("urgency_level", "string"), ("region", "string"), ("specialist_availability", "bigint"),
               ("facility_beds", "bigint"), ("nurse_staff_ratio", "double"), ("triage_time_min", "double"),
               ("registration_time_min", "double"), ("visit_hour", "int"), ("urgency_priority", "int"))
VCOLS = [c for c, _ in VISIT_TYPES]
NUMERIC_VISIT = [c for c, t in VISIT_TYPES if t in ("bigint", "double", "int")]
BOX_COLS = ["wait_min", "patient_load", "specialist_availability", "facility_beds", "nurse_staff_ratio",
            "triage_time_min", "registration_time_min", "visit_hour"]
CORR_COLS = NUMERIC_VISIT

GAPPY = with_views("visits_gappy")


def _gappy(spark, sf):
    return V.visits_gappy(spark, sf)


def _union(parts):
    return "\n UNION ALL ".join(parts)


@query("table_metrics", GAPPY + f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(VCOLS)} AS n_columns,
       CAST({" + ".join(f"count(*) - count({c})" for c in VCOLS)} AS BIGINT) AS missing_cells
FROM visits_gappy""")
def table_metrics(spark, sf):
    return B.table_metrics(_gappy(spark, sf))


_COLINFO = GAPPY + ", ci AS (" + _union(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM visits_gappy"
    for c, t in VISIT_TYPES) + ")\n"


@query("column_info", _COLINFO + "SELECT * FROM ci")
def column_info(spark, sf):
    return B.column_info(_gappy(spark, sf))


@query("missing_by_column", _COLINFO + """
SELECT CAST(row_number() OVER (ORDER BY missing_count DESC, column_name) AS INTEGER) AS rank, column_name, missing_count
FROM ci WHERE missing_count > 0""")
def missing_by_column(spark, sf):
    return B.missing_by_column(_gappy(spark, sf))


@query("data_quality", GAPPY + f""",
t AS (SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(VCOLS)} AS n_columns,
             CAST({" + ".join(f"count(*) - count({c})" for c in VCOLS)} AS BIGINT) AS missing_cells FROM visits_gappy)
SELECT n_rows, n_columns, missing_cells,
       round((1 - missing_cells / (n_rows * n_columns)) * 100, 6) AS quality_pct,
       round(missing_cells / (n_rows * n_columns), 6) AS missing_share,
       missing_cells / (n_rows * n_columns) > 0.05 AS over_5pct, missing_cells / (n_rows * n_columns) > 0.1 AS over_10pct
FROM t""")
def data_quality(spark, sf):
    return B.data_quality(_gappy(spark, sf))


@query("describe_numeric", GAPPY + ", d AS (" + _union(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(max(CAST({c} AS DOUBLE)), 6) AS max "
    f"FROM visits_gappy" for c in NUMERIC_VISIT) + ") SELECT * FROM d")
def describe_numeric(spark, sf):
    return B.describe_numeric(_gappy(spark, sf))


@query("distinct_per_column", GAPPY + _union(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS n_distinct FROM visits_gappy" for c in VCOLS))
def distinct_per_column(spark, sf):
    return B.distinct_per_column(_gappy(spark, sf))


_KIND = {"bigint": "numeric", "int": "numeric", "double": "numeric", "timestamp_ntz": "datetime", "string": "text"}
_DT_TYPES = VISIT_TYPES + (("visit_ts_text", "string"),)


def _sem_sql(c, t):
    kind = _KIND[t]
    nd = f"count(DISTINCT {c})"
    if kind == "numeric":
        sem = f"CASE WHEN {nd} / count(*) < 0.05 AND {nd} < 20 THEN 'categorical' ELSE 'numerical' END"
    elif kind == "datetime":
        sem = "'datetime'"
    else:
        sem = (f"CASE WHEN sum(CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END) = 0 "
               f"THEN 'datetime' ELSE 'categorical' END")
    return (f"SELECT '{c}' AS column_name, '{kind}' AS storage_kind, CAST({nd} AS BIGINT) AS n_distinct, "
            f"round({nd} / count(*), 6) AS unique_ratio, {sem} AS semantic_type FROM dt")


@query("detect_types", with_views("visits_gappy", extra="dt AS (SELECT *, CAST(visit_ts AS VARCHAR) AS visit_ts_text "
                                                        "FROM visits_gappy)")
       + _union(_sem_sql(c, t) for c, t in _DT_TYPES))
def detect_types(spark, sf):
    return B.detect_types(_gappy(spark, sf).withColumn("visit_ts_text", F.col("visit_ts").cast("string")))


@query("suggest_targets", GAPPY + _union(
    f"SELECT '{c}' AS column_name, {str(c in NUMERIC_VISIT).lower()} AS is_numeric, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM visits_gappy"
    for c in VCOLS if any(w in c.lower() for w in B.TARGET_WORDS)))
def suggest_targets(spark, sf):
    return B.suggest_targets(_gappy(spark, sf))


@query("select_numeric", GAPPY + f"SELECT {', '.join(NUMERIC_VISIT)} FROM visits_gappy")
def select_numeric(spark, sf):
    df = _gappy(spark, sf)
    return df.select(*B.numeric_columns(df))


@query("head_rows", with_views("visits") + "SELECT * FROM visits ORDER BY visit_id LIMIT 5")
def head_rows(spark, sf):
    return B.head_rows(V.visits(spark, sf), "visit_id", 5)


_TOP_COLS = ["event_type", "urgency_level", "region", "specialist_availability"]


@query("top_values", GAPPY + ", c AS (" + _union(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM visits_gappy "
    f"WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in _TOP_COLS) + """)
SELECT * FROM (SELECT column_name, value, CAST(count AS BIGINT) AS count,
                      CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank
               FROM c) WHERE rank <= 3""")
def top_values(spark, sf):
    return B.top_values(_gappy(spark, sf), _TOP_COLS, k=3)


# Age bands in display order.
AGE_BANDS = ("0 to 17", "18 to 29", "30 to 49", "50 to 69", "70 or Older")


@query("ordered_counts", with_views("stays") + """,
c AS (SELECT age_group, count(*) AS n FROM stays WHERE admission_type = 'O' GROUP BY age_group)
SELECT CAST(o.pos AS INTEGER) AS position, o.age_group, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (VALUES """ + ", ".join(f"({i + 1}, '{a}')" for i, a in enumerate(AGE_BANDS)) + """) o(pos, age_group)
LEFT JOIN c USING (age_group)""")
def ordered_counts(spark, sf):
    return B.ordered_counts(V.stays(spark, sf), "age_group", AGE_BANDS, F.col("admission_type") == "O")


def _corr_sql(src: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
             f"FROM {src}" for a, b in pairs]
    parts += [f"SELECT '{b}', '{a}', round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) FROM {src}"
              for a, b in pairs]
    parts += [f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in cols]
    return _union(parts)


@query("correlation_matrix", GAPPY + _corr_sql("visits_gappy", CORR_COLS))
def correlation_matrix(spark, sf):
    return B.correlation_matrix(_gappy(spark, sf), CORR_COLS)


@query("outcome_correlation", with_views("staffing") +
       _corr_sql("staffing", ["satisfaction_score", "previous_satisfaction", "shift_hours"]))
def outcome_correlation(spark, sf):
    return B.outcome_correlation(V.staffing(spark, sf), "shift_hours")


def _hist_sql(src: str, x: str, keys: list[str], bins: int = 30) -> str:
    k = "".join(f"{c}, " for c in keys)
    gb = "GROUP BY " + ", ".join(keys) if keys else ""
    groups = f"(SELECT DISTINCT {', '.join(keys)} FROM d)" if keys else "(SELECT 1 AS one)"
    return f"""
d AS (SELECT {k}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL),
st AS (SELECT min(x) AS mn, max(x) AS mx FROM d),
c AS (SELECT {k}CAST(CASE WHEN mx - mn > 0 THEN least(floor((x - mn) / (mx - mn) * {bins}), {bins - 1}) ELSE 0 END
                     AS INTEGER) AS bin, count(*) AS cnt FROM d, st GROUP BY ALL),
g AS (SELECT gr.*, CAST(b.bin AS INTEGER) AS bin FROM {groups} gr, (SELECT unnest(range({bins})) AS bin) b)
SELECT {"".join(f"g.{c}, " for c in keys)}g.bin, round(mn + g.bin * ((mx - mn) / {bins}), 6) AS lower,
       round(CASE WHEN g.bin = {bins - 1} THEN mx ELSE mn + (g.bin + 1) * ((mx - mn) / {bins}) END, 6) AS upper,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g CROSS JOIN st LEFT JOIN c USING ({k}bin)"""


@query("histogram_30", with_views("visits") + "," + _hist_sql("visits", "wait_min", []))
def histogram_30(spark, sf):
    return B.histogram(V.visits(spark, sf), "wait_min", 30)


@query("residual_histogram", with_views("scored", extra="rs AS (SELECT model, y_true - y_pred AS residual FROM scored)") + ","
       + _hist_sql("rs", "residual", ["model"]))
def residual_histogram(spark, sf):
    s = V.scored(spark, sf).select("model", (F.col("y_true") - F.col("y_pred")).alias("residual"))
    return B.histogram(s, "residual", 30, keys=["model"])


@query("histogram_null_group", with_views("visits_gappy") + """,
d AS (SELECT urgency_level, wait_min AS x FROM visits_gappy WHERE wait_min IS NOT NULL),
st AS (SELECT min(x) AS mn, max(x) AS mx FROM d),
c AS (SELECT urgency_level, CAST(CASE WHEN mx > mn THEN least(floor((x - mn) / (mx - mn) * 10), 9) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
      FROM d, st GROUP BY ALL),
g AS (SELECT urgency_level, CAST(unnest(range(10)) AS INTEGER) AS bin FROM (SELECT DISTINCT urgency_level FROM d))
SELECT g.urgency_level, g.bin, round(mn + g.bin * ((mx - mn) / 10), 6) AS lower,
       round(CASE WHEN g.bin = 9 THEN mx ELSE mn + (g.bin + 1) * ((mx - mn) / 10) END, 6) AS upper, coalesce(n, 0) AS count
FROM st, g LEFT JOIN c ON c.urgency_level IS NOT DISTINCT FROM g.urgency_level AND c.bin = g.bin""")
def histogram_null_group(spark, sf):
    return B.histogram(V.visits_gappy(spark, sf), "wait_min", 10, keys=["urgency_level"])


@query("histogram_overlay", with_views("scored", extra="""ov AS (
  SELECT 'actual' AS series, y_true AS value FROM scored WHERE split = 'test' AND model = 'a'
  UNION ALL SELECT 'predicted', y_pred FROM scored WHERE split = 'test' AND model = 'a')""") + ","
       + _hist_sql("ov", "value", ["series"]))
def histogram_overlay(spark, sf):
    s = V.scored(spark, sf).filter((F.col("split") == "test") & (F.col("model") == "a"))
    return B.histogram_overlay(s)


def _kde_sql(src: str, x: str, keys: list[str], grid: int = 64, bins: int = 4096) -> str:
    k = "".join(f"{c}, " for c in keys)
    using = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    gb = ", ".join(keys + ["point"])
    gx = f"(mn + point * ((mx - mn) / {grid - 1}))"
    u = f"(({gx} - ctr) / h)"
    return f"""
d AS (SELECT {k}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL),
st AS (SELECT {k}count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM d {"GROUP BY " + ", ".join(keys) if keys else ""}),
b AS (SELECT {"".join(f"d.{c}, " for c in keys)}CAST(CASE WHEN mx - mn > 0 THEN least(floor((x - mn) / (mx - mn) * {bins}), {bins - 1})
                          ELSE 0 END AS INTEGER) AS b, count(*) AS c
      FROM d JOIN st {using} GROUP BY ALL),
e AS (SELECT {"".join(f"b.{c}, " for c in keys)}b.c, st.n, st.sd * pow(CAST(st.n AS DOUBLE), -0.2) AS h,
             st.mn + (b.b + 0.5) * ((st.mx - st.mn) / {bins}) AS ctr, st.mn, st.mx, p.point
      FROM b JOIN st {using}, (SELECT unnest(range({grid})) AS point) p)
SELECT {k}CAST(point AS INTEGER) AS point, round(any_value({gx}), 6) AS x,
       round(sum(c * exp(-0.5 * {u} * {u})) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM e GROUP BY {gb}"""


@query("kde_grid", with_views("visits") + "," + _kde_sql("visits", "wait_min", []))
def kde_grid(spark, sf):
    return B.kde_grid(V.visits(spark, sf), "wait_min")


@query("density_by_group", with_views("visits") + "," + _kde_sql("visits", "wait_min", ["region"]))
def density_by_group(spark, sf):
    return B.kde_grid(V.visits(spark, sf), "wait_min", keys=["region"])


def _nbox_part(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, round((any_value(lo) - any_value(m)) / nullif(any_value(s), 0), 6) AS z_min,
       round((any_value(q1) - any_value(m)) / nullif(any_value(s), 0), 6) AS z_q1,
       round((any_value(q2) - any_value(m)) / nullif(any_value(s), 0), 6) AS z_median,
       round((any_value(q3) - any_value(m)) / nullif(any_value(s), 0), 6) AS z_q3,
       round((any_value(hi) - any_value(m)) / nullif(any_value(s), 0), 6) AS z_max,
       CAST(sum(CASE WHEN {x} < round(q1 - 1.5 * (q3 - q1), 9) OR {x} > round(q3 + 1.5 * (q3 - q1), 9) THEN 1 ELSE 0 END)
            AS BIGINT) AS n_outliers
FROM visits, (SELECT avg({x}) AS m, stddev_samp({x}) AS s, min({x}) AS lo, max({x}) AS hi,
                     quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3
              FROM visits) st"""


@query("normalized_box", with_views("visits") + _union(_nbox_part(c) for c in BOX_COLS))
def normalized_box(spark, sf):
    return B.normalized_box(V.visits(spark, sf), BOX_COLS)


@query("box_by_group", GAPPY + """,
d AS (SELECT urgency_level AS group_value, wait_min AS x FROM visits_gappy WHERE wait_min IS NOT NULL),
st AS (SELECT group_value, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
              min(x) AS mn, max(x) AS mx, count(*) AS n FROM d GROUP BY group_value),
f AS (SELECT *, round(q1 - 1.5 * (q3 - q1), 9) AS f1, round(q3 + 1.5 * (q3 - q1), 9) AS f2 FROM st),
w AS (SELECT group_value, min(CASE WHEN x >= f1 AND x <= f2 THEN x END) AS wl, max(CASE WHEN x >= f1 AND x <= f2 THEN x END) AS wh,
             sum(CASE WHEN x >= f1 AND x <= f2 THEN 0 ELSE 1 END) AS no
      FROM d JOIN f USING (group_value) GROUP BY group_value)
SELECT f.group_value, CAST(n AS BIGINT) AS n, round(mn, 6) AS min, round(q1, 6) AS q1, round(q2, 6) AS median,
       round(q3, 6) AS q3, round(mx, 6) AS max, round(wl, 6) AS whisker_low, round(wh, 6) AS whisker_high,
       CAST(no AS BIGINT) AS n_outliers
FROM f JOIN w ON f.group_value IS NOT DISTINCT FROM w.group_value""")
def box_by_group(spark, sf):
    return B.box_by_group(_gappy(spark, sf), "wait_min", "urgency_level")


@query("mean_by_time", with_views("visits") + """,
t AS (SELECT wait_min, visit_hour, CAST(isodow(visit_ts) - 1 AS INTEGER) AS day_of_week FROM visits)
SELECT 'visit_hour' AS bucket_column, CAST(visit_hour AS VARCHAR) AS bucket, CAST(count(wait_min) AS BIGINT) AS n,
       round(avg(wait_min), 6) AS mean_target FROM t GROUP BY visit_hour
UNION ALL
SELECT 'day_of_week', CAST(day_of_week AS VARCHAR), CAST(count(wait_min) AS BIGINT), round(avg(wait_min), 6)
FROM t GROUP BY day_of_week""")
def mean_by_time(spark, sf):
    v = V.visits(spark, sf).withColumn("day_of_week", F.weekday("visit_ts"))
    return B.mean_by_time(v, "wait_min", ["visit_hour", "day_of_week"])


@query("scatter_sample", with_views("visits") + """
SELECT visit_id, facility_beds, nurse_staff_ratio, wait_min FROM visits""")
def scatter_sample(spark, sf):
    return B.scatter_sample(V.visits(spark, sf), "visit_id", ["facility_beds", "nurse_staff_ratio", "wait_min"])
