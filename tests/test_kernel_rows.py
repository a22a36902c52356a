"""The kernel fit's rows stay on disk, and its features are computed by
methods that the JVM compiles."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wardstats.operators import models as G
from wardstats.sources import files


def _blobs(spark, n):
    x = [F.xxhash64("id", F.lit(i)) % 1000 / 1000.0 for i in range(2)]
    return spark.range(n).select("id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
                                 x[0].alias("a"), x[1].alias("b"), (x[0] * 3 - x[1]).alias("y"))


def test_stored_rows_hold_no_memory_and_come_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(files, "ROW_GROUP_BYTES", 64 << 10)
    df = spark.range(0, 20_000, 1, 1).select("id", *[F.rand(i).alias(f"v{i}") for i in range(8)])
    with files.stored_rows(df, "trial") as rows:
        assert not rows.is_cached and not rows.storageLevel.useMemory
        [name] = rows.inputFiles()
        assert pq.ParquetFile(name.removeprefix("file:")).num_row_groups > 4
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect()))


def test_kernel_fit_caches_nothing(spark, monkeypatch):
    seen, fit = [], G.insensitive_fit

    def watched(rows, **kw):
        out = fit(rows, **kw)
        seen.append((rows.is_cached, rows.count(), spark._jsc.getPersistentRDDs().size()))
        return out

    spark.catalog.clearCache()
    before = spark._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(G, "insensitive_fit", watched)
    scored, _ = G.fit_predict(_blobs(spark, 500), ["a", "b"], "y", G.KERNEL, options=G.TrainOptions(rff_components=8))
    assert seen == [(False, 400, before)] and scored.filter("y_pred IS NULL").count() == 0 and scored.count() == 500


def test_features_are_generated_in_methods_that_are_compiled(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    try:
        G.fit_predict(_blobs(spark, 200), ["a", "b"], "y", G.KERNEL)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "20000")
        G.jit_sized_methods(spark)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "20000"
    finally:
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
