"""Streaming operators: append mode emits closed windows only, with the
same counts as the batch plan; scratch output lives under the session's
checkpoint folder."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardstats.functions.session import checkpoint_dir
from wardstats.plans import views as V
from wardstats.sources.files import scratch_path
from wardstats.streaming import alerts as M

LEVELS = ["Information", "Warning", "Critical"]
THRESHOLDS = [(40.0, "Information"), (80.0, "Warning"), (150.0, "Critical")]


def _tagged(df):
    return M.tag_alerts(df.select("visit_id", "visit_ts", F.col("wait_min").alias("v")), "v", THRESHOLDS)


def test_append_mode_emits_closed_windows_equal_to_batch(spark):
    stream = V.visits_from(M.event_stream(spark, SF_SMALL))
    counts = M.alert_frequency(_tagged(stream), "visit_ts", "alert_level", LEVELS, window="1 day",
                               watermark="1 hour")
    out = M.run_to_table(counts, "append_test", output_mode="append").collect()
    batch = M.alert_frequency(_tagged(V.visits(spark, SF_SMALL)), "visit_ts", "alert_level", LEVELS,
                              window="1 day", watermark="1 hour").collect()
    b = {r.w.start: (r.n, r.n_critical) for r in batch}
    assert 0 < len(out) < len(b)  # the last window stays open under availableNow
    for r in out:
        assert b[r.w.start] == (r.n, r.n_critical)


def test_stream_tagging_equals_batch(spark):
    s = M.run_to_table(_tagged(V.visits_from(M.event_stream(spark, SF_SMALL))), "tag_test")
    a = sorted((r.visit_id, r.alert_level) for r in s.collect())
    b = sorted((r.visit_id, r.alert_level) for r in _tagged(V.visits(spark, SF_SMALL)).collect())
    assert a == b


def test_scratch_output_under_checkpoint_dir(spark):
    root = checkpoint_dir(spark)
    assert root and scratch_path(spark, "x").replace("file:", "").startswith(root.replace("file:", ""))


def test_counts_add_up_over_batches_and_late_rows_are_kept(spark):
    """Two files, two micro-batches: the second holds a row of a day that the
    first has closed, one of an open day, one of a new day, and one without a
    time."""
    folder = scratch_path(spark, "two-files")
    first = [(1, "2024-01-01 10:00:00", 50.0), (2, "2024-01-03 10:00:00", 200.0), (3, "2024-01-03 11:00:00", 1.0)]
    second = [(4, "2024-01-01 12:00:00", 90.0), (5, "2024-01-03 09:00:00", 90.0), (6, "2024-01-04 01:00:00", 10.0), (7, None, 10.0)]
    for part in (first, second):
        df = spark.createDataFrame(part, "visit_id int, ts string, v double").withColumn("visit_ts", F.col("ts").cast("timestamp_ntz"))
        df.drop("ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("visit_id int, v double, visit_ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    counts, late = M.run_counts(M.tag_alerts(stream, "v", THRESHOLDS), "two_batches", "visit_ts", "alert_level", LEVELS)
    got = {str(r.day)[:10]: (r.n, r.n_information, r.n_warning, r.n_critical)
           for r in counts.select(M.utc_day_text(F.col("w.start")).alias("day"), "*").collect()}
    assert got == {"2024-01-01": (1, 1, 0, 0), "2024-01-03": (3, 0, 1, 1), "2024-01-04": (1, 0, 0, 0)}
    assert [(r.visit_id, r.alert_level, r.epoch) for r in late.collect()] == [(4, "Warning", 1)]


def test_counts_of_one_batch_equal_the_windowed_aggregate(spark):
    stream = V.visits_from(M.event_stream(spark, SF_SMALL))
    counts, late = M.run_counts(_tagged(stream), "one_batch", "visit_ts", "alert_level", LEVELS)
    batch = M.alert_frequency(_tagged(V.visits(spark, SF_SMALL)), "visit_ts", "alert_level", LEVELS)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, batch.collect()))
    assert late.count() == 0
