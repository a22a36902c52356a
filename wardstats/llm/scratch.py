"""Tables written between passes, and joins against tables of a checked size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: With it Spark removes a query's shuffle files when the query is done.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A writer holds one row group; rows here can be packed arrays of some 100 kB.
ROW_GROUP_BYTES = 16 << 20
#: A table is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A folder of this
    machine is taken only where that is unset and the master is local."""
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="wardstats-llm-")
        sc.setCheckpointDir(path)
    return path


class Scope:
    """Paths of the tables stored in it."""

    def __init__(self) -> None:
        self.made: dict[str, SparkSession] = {}

    def keep(self, table_: DataFrame) -> DataFrame:
        """``table_``, which the scope's end will not remove."""
        self.made.pop(table_.stored_path, None)
        for outer in _scopes[:-1][-1:]:
            outer.made[table_.stored_path] = table_.sparkSession
        return table_


_scopes: list[Scope] = []


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Tables stored inside are removed at the end, but for those kept. What
    leaves the scope must be such a table or nothing that reads another."""
    mine = Scope()
    _scopes.append(mine)
    try:
        yield mine
    finally:
        _scopes.pop()
        for path, spark in mine.made.items():
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends
    there, so a lost executor costs a reread and no recomputation, and its
    shuffle files go. ``batch_rows`` are the most rows of an Arrow batch on
    the way; a task and its worker hold a batch each."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {CLEANUP_CONF: "true"} | ({} if batch_rows is None else {BATCH_CONF: str(batch_rows)})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if _scopes:
        _scopes[-1].made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def sized(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted size is below
    BROADCAST_BYTES, else unchanged: then the join shuffles both sides and
    AQE splits skewed partitions. ``small`` should be a stored table."""
    rows = BROADCAST_BYTES // row_bytes
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """A string that two rows share only if they have the same id and text
    (by MD5); integer ids keep their order in it, and no id comes last."""
    number = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")
    text = F.col(text_col).cast("string")
    return F.concat(F.coalesce(number, F.lit("~")), F.when(text.isNull(), ":").otherwise("="), F.md5(F.coalesce(text, F.lit(""))))
