"""Queries for sources and sinks (A1-A5, A7) and text normalisation (A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views
from wardstats.sources import files as A
from wardstats.sources.tables import table_path

_RT_COLS = ["visit_id", "visit_ts", "event_type", "wait_min", "patient_load", "region", "nurse_staff_ratio"]


@query("csv_roundtrip", with_views("visits") + f"SELECT {', '.join(_RT_COLS)} FROM visits")
def csv_roundtrip(spark, sf):
    return A.csv_roundtrip(V.visits(spark, sf).select(*_RT_COLS), "visits")


# what the SQL expects: table -> (columns, numeric, text, datetime); Spark reads the files' schemas
_CATALOG = {"region": (2, 1, 1, 0), "nation": (3, 2, 1, 0), "customer": (5, 3, 2, 0), "supplier": (4, 3, 1, 0),
            "part": (6, 3, 3, 0), "orders": (6, 3, 2, 1), "lineitem": (11, 8, 2, 1), "events": (6, 3, 2, 1),
            "documents": (5, 2, 3, 0), "embeddings": (3, 2, 0, 0), "pages": (3, 1, 2, 0), "benchmark": (2, 1, 1, 0),
            "labels": (3, 3, 0, 0), "conversations": (4, 2, 2, 0)}


@query("catalog_summary", "SELECT *, CAST(sum(n_rows) OVER () AS BIGINT) AS total_records FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, {c} AS n_columns, {n} AS n_numeric, "
    f"{x} AS n_text, {d} AS n_datetime FROM {t}" for t, (c, n, x, d) in _CATALOG.items()) + ")")
def catalog_summary(spark, sf):
    return A.catalog_summary(A.load_catalog(spark, [table_path(sf, t) for t in _CATALOG]))


@query("stringify_nulls", with_views("visits_gappy") + """
SELECT visit_id, coalesce(event_type, 'nan') AS event_type, coalesce(urgency_level, 'nan') AS urgency_level,
       coalesce(region, 'nan') AS region FROM visits_gappy""")
def stringify_nulls(spark, sf):
    return A.stringify_nulls(V.visits_gappy(spark, sf).select("visit_id", "event_type", "urgency_level", "region"))


def _visits_csv(spark, sf):
    """The visits as CSV text in which every 50th row's wait is no number
    (bad rows derived from the table, as the driver's files hold none)."""
    v = V.visits(spark, sf).select("visit_id", "event_type", "wait_min", "patient_load", "region")
    v = v.withColumn("wait_min", F.when(F.col("visit_id") % 50 == 7, "n/a").otherwise(F.col("wait_min").cast("string")))
    return A.write_csv(v, A.scratch_path(spark, "visits-csv"))


@query("csv_inferred", with_views("visits") + "SELECT visit_id, event_type, wait_min, patient_load, region FROM visits WHERE visit_id % 50 <> 7")
def csv_inferred(spark, sf):
    return A.read_csv_checked(spark, _visits_csv(spark, sf))[0]


@query("csv_rejects", with_views("visits") + "SELECT CAST(visit_id AS VARCHAR) AS visit_id, 'wait_min' AS bad_columns FROM visits WHERE visit_id % 50 = 7")
def csv_rejects(spark, sf):
    bad = A.read_csv_checked(spark, _visits_csv(spark, sf))[1]
    return bad.select(F.split(A.REJECT, ",")[0].alias("visit_id"), F.array_join("_columns", ",").alias("bad_columns"))


@query("published_visits", with_views("visits") + "SELECT region, CAST(count(*) AS BIGINT) AS n_visits FROM visits GROUP BY region")
def published_visits(spark, sf):
    path = A.scratch_path(spark, "published")
    A.publish(V.visits(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("n_visits")), path)
    return A.read_published(spark, path)
