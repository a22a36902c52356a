"""Domain views over the driver's tables.

Every view is a lazy projection/join of the parquet tables, so its size grows
with the data and Catalyst prunes the columns a query does not use. The
matching DuckDB definitions live in :mod:`wardstats.plans.sqlviews`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstats.functions.stats import corr
from wardstats.functions.joins import lookup_join, settled
from wardstats.sources.tables import read_table

# Model names of the stand-in `scored` table and the visit
# features whose importance is derived from it.
MODELS = ("a", "b", "c", "d")
VISIT_FEATURES = ("nurse_staff_ratio", "specialist_availability", "facility_beds",
                  "patient_load", "triage_time_min", "registration_time_min",
                  "visit_hour", "urgency_priority")
TEST_PERCENT = 20


def _case(c, pairs, default=None):
    out = None
    for k, v in pairs:
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if default is None else out.otherwise(default)


def urgency_from_event(et):
    return _case(et, [("error", "Critical"), ("purchase", "High"),
                      ("signup", "Medium"), ("click", "Low")])


def split_col(id_col, test_percent: int = TEST_PERCENT, salt: str = ""):
    """Reproducible train/test assignment from the md5 of the id."""
    key = F.col(id_col).cast("string")
    if salt:
        key = F.concat(F.lit(salt), key)
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < test_percent, "test").otherwise("train")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER visits: one row per `events` row."""
    return visits_from(read_table(spark, sf_dir, "events"))


def visits_from(ev: DataFrame) -> DataFrame:
    """The `visits` projection of an events frame (batch or streaming)."""
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return ev.select(
        eid.alias("visit_id"),
        uid.alias("patient_id"),
        F.col("ts").alias("visit_ts"),
        et.alias("event_type"),
        F.col("value").alias("wait_min"),
        F.get_json_object("props", "$.k").try_cast("int").alias("patient_load"),
        urgency_from_event(et).alias("urgency_level"),
        _case(uid % 5, [(0, "North"), (1, "South"), (2, "East"), (3, "West")],
              F.lit("Central")).alias("region"),
        (uid % 7 + 1).alias("specialist_availability"),
        _case(uid % 4, [(0, 150), (1, 200), (2, 300)], F.lit(500)).cast("bigint").alias("facility_beds"),
        (F.lit(0.15) + (eid % 21) / F.lit(100.0)).alias("nurse_staff_ratio"),
        (F.col("value") * F.lit(0.3) + (eid % 5)).alias("triage_time_min"),
        (F.col("value") * F.lit(0.05) + (eid % 9)).alias("registration_time_min"),
        F.hour("ts").alias("visit_hour"),
        _case(urgency_from_event(et), [("Low", 1), ("Medium", 2), ("High", 3), ("Critical", 4)],
              F.lit(2)).alias("urgency_priority"),
    )


def visits_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`visits` with injected gaps (driver tables have no NULLs)."""
    v = visits(spark, sf_dir)
    vid = F.col("visit_id")
    return v.withColumns({
        "wait_min": F.when(vid % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("wait_min")),
        "urgency_level": F.when(vid % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("urgency_level")),
        "patient_load": F.when(vid % 6 == 0, F.lit(None).cast("int")).otherwise(F.col("patient_load")),
    })


def facility_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's region: region / cost data."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.select(
        F.col("o_orderkey").alias("visit_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("o_orderdate").alias("visit_ts"),
        F.col("o_totalprice").alias("cost"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff scheduling rows: lineitem with its part and supplier."""
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    s = read_table(spark, sf_dir, "supplier")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("staff_id"),
        F.col("p_type").alias("department"),
        F.col("l_quantity").alias("shift_hours"),
        (F.col("l_quantity") * F.col("l_tax")).alias("overtime_hours"),
        (F.col("l_linenumber") + F.col("s_nationkey")).cast("bigint").alias("patient_load"),
        (F.col("l_suppkey") % 6).alias("absenteeism_days"),
        F.col("p_size").cast("double").alias("years_experience"),
        (F.col("p_retailprice") / F.lit(100.0)).alias("satisfaction_score"),
        (F.col("p_retailprice") / F.lit(110.0)).alias("previous_satisfaction"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inpatient discharges derived from lineitem."""
    li = read_table(spark, sf_dir, "lineitem")
    los = F.floor(F.col("l_quantity") * F.lit(2.6)).cast("bigint")
    rf = F.col("l_returnflag")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stay_id"),
        F.when(los >= 120, F.lit("120 +")).otherwise(los.cast("string")).alias("length_of_stay"),
        _case(rf, [("A", "Expired"), ("R", "Home")]).alias("disposition"),
        F.col("l_linestatus").alias("admission_type"),
        _case(F.col("l_partkey") % 5, [(0, "0 to 17"), (1, "18 to 29"), (2, "30 to 49"),
                                       (3, "50 to 69")], F.lit("70 or Older")).alias("age_group"),
        _case(F.col("l_suppkey") % 3, [(0, "U"), (1, "F")], F.lit("M")).alias("gender"),
        _case(F.col("l_linenumber") % 5, [(1, "Minor"), (2, "Moderate"), (3, "Major"),
                                          (4, "Extreme")]).alias("risk_of_mortality"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_suppkey")).alias("facility_id"),
        F.col("l_extendedprice").alias("total_charges"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of model outputs: (id, dataset, split, y_true, model, y_pred,
    group columns, features). Four stand-in models; `c` predicts the mean of
    its event type, `d` is biased."""
    v = visits(spark, sf_dir)
    type_mean = v.groupBy("event_type").agg(F.avg("wait_min").alias("type_mean"))
    v = lookup_join(v, settled(type_mean), "event_type")
    vid, y = F.col("visit_id"), F.col("wait_min")
    preds = F.array(
        F.struct(F.lit("a").alias("model"), (F.lit(0.85) * y + (vid % 23) - 6).alias("y_pred")),
        F.struct(F.lit("b").alias("model"), (F.lit(0.6) * y + (vid % 11) + 10).alias("y_pred")),
        F.struct(F.lit("c").alias("model"), F.col("type_mean").alias("y_pred")),
        F.struct(F.lit("d").alias("model"), (y - 25 + (vid % 5)).alias("y_pred")),
    )
    return v.select(
        vid.alias("id"),
        F.col("event_type").alias("dataset"),
        F.lit("wait_min").alias("target"),
        split_col("visit_id").alias("split"),
        y.alias("y_true"),
        "urgency_level", "region",
        "nurse_staff_ratio", "specialist_availability", "facility_beds", "patient_load",
        "triage_time_min", "registration_time_min", "visit_hour", "urgency_priority",
        F.inline(preds),
    )


def importance(spark: SparkSession, sf_dir: str, scored_df: DataFrame | None = None) -> DataFrame:
    """Feature importance per model: |corr(feature, y_pred)| normalised to
    sum 1 within the model. One wide aggregate, then `stack`."""
    s = scored_df if scored_df is not None else scored(spark, sf_dir)
    wide = s.groupBy("model").agg(*[
        F.coalesce(F.abs(corr(f, "y_pred")), F.lit(0.0)).alias(f)
        for f in VISIT_FEATURES])
    stack = "stack({}, {}) as (feature, raw)".format(
        len(VISIT_FEATURES), ", ".join(f"'{f}', `{f}`" for f in VISIT_FEATURES))
    long = wide.selectExpr("model", stack)
    from pyspark.sql import Window
    total = F.sum("raw").over(Window.partitionBy("model"))
    return long.select("model", "feature", F.round(F.try_divide(F.col("raw"), total), 9).alias("score"))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison table of the stand-in models per dataset (one row per
    (dataset, model)); see :func:`wardstats.operators.evaluate.comparison`."""
    from wardstats.operators.evaluate import comparison as build

    return build(scored(spark, sf_dir))
