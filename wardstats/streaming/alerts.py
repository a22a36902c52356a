"""Structured Streaming operators built from fitted batch tables
(SURVEY §2.14, M1-M3).

Thresholds and model coefficients are fitted in batch and enter the stream
as literals (a handful of numbers), so the streaming plans are stateless
projections except the windowed alert counts, which keep per-window state
bounded by the watermark. Results go to a parquet (file) sink under the
shared checkpoint folder — never a driver-side memory sink — with the
stream checkpoint next to it, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.sources.files import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", schema: T.StructType | None = None,
                 max_files: int | None = None) -> DataFrame:
    """File stream over one table of a data folder (``pathGlobFilter``);
    the schema comes from the batch table."""
    schema = schema or spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def level_expr(value: Column, thresholds: list[tuple[float, str]], default: str = "None") -> Column:
    """Highest threshold exceeded (strict ``>``), thresholds as literals."""
    out = None
    for t, lvl in sorted(thresholds, key=lambda x: -x[0]):
        out = F.when(value > F.lit(float(t)), lvl) if out is None else out.when(value > F.lit(float(t)), lvl)
    return out.otherwise(default) if out is not None else F.lit(default)


def run_to_table(stream_df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming plan over all available input (``availableNow``) into
    a parquet folder and return that folder as a batch DataFrame."""
    spark = stream_df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    if output_mode == "append":
        q = (stream_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        # complete/update modes: every micro-batch carries the full result, so
        # each batch overwrites the folder; the last one is the final table
        def sink(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = (stream_df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


def run_counts(rows: DataFrame, name: str, ts: str, level: str, levels, window: str = "1 day",
               allowed: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """M2: (counts, late rows) of a stream with at least one file, without a state store. Counts add
    up, so each micro-batch writes only its own count per window, to the
    folder of its epoch; a batch that is run again overwrites that folder, and
    a reader adds the epochs (columns as in :func:`alert_frequency`). A row is
    late if its window had ended ``allowed`` before the latest event time of
    earlier epochs; late rows are not counted but kept, whole, in the second
    frame, with their ``epoch``. What a batch knows of earlier ones is one
    number per epoch. Rows without a time are in neither frame. Runs over all
    available input."""
    spark = rows.sparkSession
    root, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    t = utc_instant(F.col(ts)) if isinstance(rows.schema[ts].dataType, T.TimestampNTZType) else F.col(ts)
    timed = rows.withColumn("_ts", t).filter(F.col("_ts").isNotNull())
    names = [f"n_{lv.lower()}" for lv in levels]

    def put(df: DataFrame, kind: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{kind}/epoch={epoch}")

    def sink(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        known = s.read.schema("mark bigint, epoch bigint").parquet(f"{root}/marks").filter(F.col("epoch") < epoch).agg(F.max("mark")).first()[0] if epoch else None
        batch = batch.withColumn("w", F.window("_ts", window)).persist()
        try:
            closed = F.lit(False) if known is None else F.col("w.end") <= F.timestamp_micros(F.lit(known)) - F.expr(f"INTERVAL {allowed}")
            put(batch.filter(~closed).groupBy("w").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum((F.col(level) == lv).cast("bigint")).alias(c) for lv, c in zip(levels, names)]), "counts", epoch)
            put(batch.filter(closed).select(*rows.columns), "late", epoch)
            put(batch.agg(F.greatest(F.max(F.unix_micros("_ts")), F.lit(known).cast("bigint")).alias("mark")), "marks", epoch)
        finally:
            batch.unpersist()

    q = (timed.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    counted = "w struct<start timestamp, end timestamp>, " + ", ".join(f"{c} bigint" for c in ("n", *names))
    counts = spark.read.schema(counted).parquet(f"{root}/counts").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return counts, spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{root}/late")


def tag_alerts(rows: DataFrame, value: str, thresholds: list[tuple[float, str]], out: str = "alert_level") -> DataFrame:
    """M1: stateless tagging of each row with its alert level."""
    return rows.withColumn(out, level_expr(F.col(value), thresholds))


def utc_instant(ntz: Column) -> Column:
    """A ``timestamp_ntz`` wall clock read as UTC, as an event-time
    ``timestamp`` — independent of the session time zone (a plain cast would
    read it in the session zone)."""
    return F.make_timestamp_ltz(F.year(ntz), F.month(ntz), F.dayofmonth(ntz), F.hour(ntz), F.minute(ntz),
                                F.date_part(F.lit("SECOND"), ntz), F.lit("UTC"))


def utc_day_text(instant: Column) -> Column:
    """'yyyy-MM-dd 00:00:00' of a UTC-midnight instant, from epoch micros
    (no session-zone formatting)."""
    day = (F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit(" 00:00:00"))


def alert_frequency(rows: DataFrame, ts: str, level: str, levels, window: str = "1 day",
                    watermark: str = "1 hour") -> DataFrame:
    """M2: rows per tumbling window and the count of each alert level (one
    aggregation with conditional counts, state bounded by the watermark).
    ``timestamp_ntz`` becomes a UTC event time for the watermark."""
    t = utc_instant(F.col(ts)) if isinstance(rows.schema[ts].dataType, T.TimestampNTZType) else F.col(ts)
    r = rows.withColumn("_ts", t).withWatermark("_ts", watermark)
    return r.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(level) == lv).cast("bigint")).alias(f"n_{lv.lower()}") for lv in levels])
