"""What a task holds or gets must not follow from few groups, wide rows or
repeated passes; results stay those of the plain forms."""

import contextlib

from pyspark.sql import functions as F


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _wide(spark):
    return spark.createDataFrame([(1, "a", 0.0, "2024-01-01"), (2, None, -0.0, "2024-01-02"), (2, "b", None, None)], "i int, s string, x double, t string")


def test_distinct_counts_hold_one_column_at_a_time(spark, capsys):
    from wardstats.operators import profile as B

    df = _wide(spark)
    got = B.distinct_per_column(df)
    assert {r.column_name: r.n_distinct for r in got.collect()} == {"i": 2, "s": 3, "x": 2, "t": 3}
    kinds = B.detect_types(df)
    assert {r.column_name: (r.n_distinct, r.semantic_type) for r in kinds.collect()} == {
        "i": (2, "numerical"), "s": (2, "categorical"), "x": (1, "numerical"), "t": (2, "datetime")}
    named = B.suggest_targets(df.withColumnsRenamed({"x": "wait", "t": "time"}))
    assert sorted(tuple(r) for r in named.collect()) == [("time", False, 2, 2), ("wait", True, 2, 1)]
    for out in (got, kinds, named):
        assert "Expand" not in _plan(out, capsys)


@contextlib.contextmanager
def _no_automatic_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_scored_rows_are_not_dealt_by_a_few_types(spark, capsys):
    from tests.conftest import SF_SMALL
    from wardstats.plans import views as V

    with _no_automatic_broadcast(spark):
        plan = _plan(V.scored(spark, SF_SMALL), capsys)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_codes_of_few_values_are_broadcast(spark, capsys):
    from wardstats.operators import prep as P

    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 4 else None) for i in range(40)], "id int, c string")
    with _no_automatic_broadcast(spark):
        out = P.ordinal_encode(df, ["c"])
        plan = _plan(out, capsys)
    assert "SortMergeJoin" not in plan
    assert {r.id: r.c for r in out.collect()} == {i: float(i % 3) if i % 4 else None for i in range(40)}


def test_percentiles_of_few_groups_are_not_dealt_by_group(spark, capsys):
    from wardstats.functions.percentiles import grouped, percentile_of

    df = spark.createDataFrame([("a" if i % 2 else None, float(i)) for i in range(100)], "g string, x double")
    with _no_automatic_broadcast(spark):
        out = grouped(df, ["g"], percentile_of("x", [0.0, 0.5, 1.0]).alias("p"))
        plan = _plan(out, capsys)
    assert "Scan ExistingRDD[g" in plan and "BroadcastHashJoin" in plan
    assert {r.g: list(r.p) for r in out.collect()} == {"a": [1.0, 50.0, 99.0], None: [0.0, 49.0, 98.0]}


def test_shallow_forests_fill_few_statistics_at_a_time():
    from wardstats.operators import models as G

    assert G.estimator(G.RANDOM_FOREST).getMaxMemoryInMB() == G.NODE_STATISTICS_MB
    assert G.estimator(G.RANDOM_FOREST, maxDepth=30).getMaxMemoryInMB() == 256
    assert G.estimator(G.RANDOM_FOREST, maxMemoryInMB=64).getMaxMemoryInMB() == 64


def test_folds_are_fitted_at_once(spark, monkeypatch):
    """Each fit waits until another has begun; one at a time never passes."""
    import threading

    from wardstats.operators import models as G

    df = spark.range(60).select("id", F.lit("train").alias("split"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2).cast("double").alias("y"))
    both, real = threading.Barrier(2, timeout=20), G.fit_predict

    def met(*args, **kw):
        both.wait()
        return real(*args, **kw)

    monkeypatch.setattr(G, "fit_predict", met)
    got = {r.fold: r.r2 for r in G.refit_scores(df, ["x"], "y", G.LINEAR, folds=2).collect()}
    assert sorted(got) == [0, 1] and all(abs(v - 1) < 1e-9 for v in got.values())


def test_stored_sets_batch_size_only_for_its_write(spark):
    from wardstats.llm import scratch

    seen = spark.conf.get(scratch.BATCH_CONF)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with scratch.scope():
        out = scratch.stored(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), "sizes", 30)
        assert max(r.n for r in out.collect()) <= 30
    assert spark.conf.get(scratch.BATCH_CONF) == seen
