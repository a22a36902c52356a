"""Session helpers: local session for tests/bench and checkpoint directory."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int = 8, shuffle_partitions: int | None = None,
                  app: str = "wardstats") -> SparkSession:
    """A local session configured like the cluster one (AQE, UTC, no UI).

    On a cluster, build the session with the cluster's own settings and call
    :func:`ensure_checkpoint_dir` instead."""
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    try:
        sc = spark.sparkContext
        return sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT_CONF, None)
    except Exception:  # noqa: BLE001 - no SparkContext on this client (e.g. Spark Connect)
        return spark.conf.get(CHECKPOINT_CONF, None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Read ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) take a fresh scratch folder. Returns the folder in use."""
    path = checkpoint_dir(spark)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wardstats-ckpt-")
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        return path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"


def jit_sized_methods(spark: SparkSession) -> None:
    """Spark fuses a stage into one generated method of up to 64 KB; the JVM
    compiles none above 8000 bytes and interprets it, some 20 times slower.
    With this limit such a stage (of very many expressions) is generated in
    small methods instead. A limit that the session has set stays."""
    if spark.conf.get(METHOD_CONF) == "65535":
        spark.conf.set(METHOD_CONF, "8000")
