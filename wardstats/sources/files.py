"""File sources and sinks, the table catalog and text normalisation
(SURVEY §2.1, A1-A5, A7).

Scratch output goes under the shared folder the cluster names in
``spark.checkpoint.dir`` (a machine-local folder only in local tests), so a
lost executor never takes written data with it.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.functions.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "wardstats", f"{name}-{uuid.uuid4().hex}")


#: Rows of a stored table that a task writes or reads at once.
ROW_GROUP_BYTES = 8 << 20


@contextmanager
def stored_rows(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written to the shared scratch folder and read back for the time
    of a ``with``: for iterative fits, whose many jobs then plan a bare scan
    instead of everything ``df`` was made by. Rows stay on disk, in small row
    groups, so that a task holds ``ROW_GROUP_BYTES`` of them however many there
    are. The folder goes at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**{"parquet.block.size": ROW_GROUP_BYTES, "parquet.enable.dictionary": "false", "compression": "none"}).parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# Timestamps keep microseconds in CSV text (Spark's default writes millis).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_OPTIONS = {"timestampFormat": TS_FORMAT + "XXX", "timestampNTZFormat": TS_FORMAT}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A1: CSV with a header; an explicit schema avoids the inference pass
    (and the int-for-bigint narrowing of ``inferSchema``)."""
    r = spark.read.option("header", True).options(**TS_OPTIONS)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


# ---------------------------------------------------------------- inferred types, rejected rows

#: Types a text column may get, narrowest first.
INFERRED = ("boolean", "bigint", "double", "date", "timestamp_ntz")
#: Column that keeps the whole text of a row that does not fit its schema.
REJECT = "_rejected"


def infer_types(rows: DataFrame, min_share: float = 1.0) -> T.StructType:
    """A1: the narrowest type of ``INFERRED`` that at least ``min_share`` of
    each text column's values (trimmed, empty text as NULL) can be cast to,
    else string; a column without values is string. One aggregate of counts
    over all rows, whatever their number; a row of counts reaches the driver."""
    values = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns}
    counts = [F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())]
    counts += [F.count(v.try_cast(t)).alias(f"n{i}_{t}") for i, v in enumerate(values.values()) for t in INFERRED]
    got = rows.agg(*counts).first()

    def kind(i: int) -> str:
        fits = [t for t in INFERRED if got[f"n{i}"] and got[f"n{i}_{t}"] >= min_share * got[f"n{i}"]]
        if "date" in fits and got[f"n{i}_timestamp_ntz"] and _timed(i):
            fits.remove("date")
        return fits[0] if fits else "string"

    clock = rows.agg(*[F.count(F.when(v.rlike(r"\d{1,2}:\d{2}"), 1)).alias(f"c{i}") for i, v in enumerate(values.values())]).first()

    def _timed(i: int) -> bool:
        return clock[f"c{i}"] > 0

    return T.StructType([T.StructField(c, T._parse_datatype_string(kind(i))) for i, c in enumerate(values)])


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str | None = None, min_share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """A1: (rows, rejects) of CSV text with a header. Without a schema the
    types are those that ``min_share`` of a column's values fit
    (:func:`infer_types`). A row with too many or too few fields, or with a
    value that its column's type can't hold, is not in ``rows`` with a NULL in
    its place but in ``rejects``, with its text (``_rejected``) and the names
    of the columns that did not fit (``_columns``; empty for a wrong number of
    fields). Empty fields are NULL and fit. Files may hold their columns in one
    order only. Both frames read the files lazily."""
    names = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(REJECT, T.StringType())])
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT).schema(text).csv(path)
    if schema is None:
        schema = infer_types(raw.filter(F.col(REJECT).isNull()).select(*[f"`{c}`" for c in names]), min_share)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    value = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")) for f in schema.fields}
    cast = {f.name: F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else value[f.name].try_cast(f.dataType) for f in schema.fields}
    bad = F.array_compact(F.array(*[F.when(value[c].isNotNull() & cast[c].isNull(), F.lit(c)) for c in value]))
    marked = raw.withColumn("_columns", bad)
    whole = F.col(REJECT).isNull()
    rows = marked.filter(whole & (F.size("_columns") == 0)).select(*[cast[c].alias(c) for c in value])
    line = F.coalesce(F.col(REJECT), F.to_csv(F.struct(*[f"`{c}`" for c in names])))
    rejects = marked.filter(~whole | (F.size("_columns") > 0)).select(line.alias(REJECT), F.when(whole, F.col("_columns")).otherwise(F.array().cast("array<string>")).alias("_columns"))
    return rows, rejects


# ---------------------------------------------------------------- published tables

#: Name of the small file that says which version of a table is valid.
MANIFEST = "CURRENT.txt"


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """A5: write ``df`` as a new version of the table at ``path`` and make it
    valid at once. Spark's committer leaves a version's folder without
    ``_SUCCESS`` until all its tasks are done, and each task's files count once
    however often it is retried; only then the manifest is replaced, by a
    rename. A writer that dies leaves the last version valid and readable. The
    ``keep`` latest versions stay, for readers that began before. One writer
    at a time."""
    spark = df.sparkSession
    version = f"v{int(time.time() * 1e6):020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    jvm = spark._jvm.org.apache.hadoop
    root = jvm.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm.fs.Path(f"{path}/{version}/_SUCCESS")):
        raise OSError(f"{path}/{version} is not complete")
    context = jvm.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    fresh = jvm.fs.Path(f"{path}/{MANIFEST}.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    option = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    option[0] = getattr(jvm.fs, "Options$Rename").OVERWRITE
    context.rename(fresh, jvm.fs.Path(f"{path}/{MANIFEST}"), option)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v"))
    for old in [v for v in versions[:-keep] if v != version]:
        fs.delete(jvm.fs.Path(f"{path}/{old}"), True)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The valid version of the table at ``path``."""
    version = spark.read.text(f"{path}/{MANIFEST}").first()
    return spark.read.parquet(f"{path}/{version['value']}")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A4/A5: CSV with a header, no index column; one file per partition."""
    df.write.mode(mode).option("header", True).options(**TS_OPTIONS).csv(path)
    return path


def csv_roundtrip(df: DataFrame, name: str = "roundtrip") -> DataFrame:
    """Write ``df`` as CSV to the shared scratch folder and read it back with
    the same schema."""
    spark = df.sparkSession
    path = write_csv(df, scratch_path(spark, name))
    return read_csv(spark, path, df.schema)


def load_catalog(spark: SparkSession, paths, fmt: str = "parquet") -> dict[str, DataFrame]:
    """A2: each file becomes a named table (file stem), also registered as a
    temp view for SQL."""
    out = {}
    for p in paths:
        name = os.path.splitext(os.path.basename(p.rstrip("/")))[0]
        df = spark.read.format(fmt).option("header", True).load(p) if fmt == "csv" else spark.read.format(fmt).load(p)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.StringType):
        return "text"
    return "other"


def catalog_summary(catalog: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table (plus column counts by kind) and the
    total number of records, as one union of per-table counts."""
    parts = []
    for name, df in catalog.items():
        kinds = [_kind(f.dataType) for f in df.schema.fields]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(kinds)).alias("n_columns"),
            F.lit(kinds.count("numeric")).alias("n_numeric"), F.lit(kinds.count("text")).alias("n_text"),
            F.lit(kinds.count("datetime")).alias("n_datetime")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    from pyspark.sql import Window

    return out.withColumn("total_records", F.sum("n_rows").over(Window.partitionBy()))


def stringify_nulls(df: DataFrame, cols=None) -> DataFrame:
    """A3: text columns as strings with NULL written as 'nan' (the upload
    page's ``astype(str)``)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols})
