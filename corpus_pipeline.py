"""A training-data pipeline over ``documents``: quality rules, near
duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet in the shared scratch folder, rereads it as the next
stage's input and removes what the stage stored on its way. All but the last return the columns of ``documents``. Rows are
dealt with as each operator's docstring says; a row is judged by its own
text, also where several share an id or have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstats.llm.decontaminate import without_contaminated
from wardstats.llm.jaccard import near_duplicates
from wardstats.llm.packing import minimum_bin_slack, token_pieces
from wardstats.llm.phrases import repeated_bytes
from wardstats.llm.quality import filter_quality
from wardstats.llm.scratch import row_key, scope, sized, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest
    id (rows without an id come last), then of the first text by MD5.
    Documents without words link to nothing and stay. Of rows that repeat an
    id and its text one stays."""
    key = row_key("doc_id", "text")
    with scope() as inner:
        rows = near_duplicates(docs.select(key.alias("_row"), "text"), 5, 80, id_col="_row")
        kept = inner.keep(stored(rows.where("doc_id = component_id OR n_shingles = 0").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows")), "kept"))
    once, several = (sized(kept.where(x), 80) for x in ("_rows = 1", "_rows > 1"))
    out = docs.join(once, key == once["_kept"], "left_semi")
    if several.isEmpty():
        return out
    return out.unionByName(docs.join(several, key == several["_kept"], "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a character
    that a cut divides goes whole, and n_chars counts what is left."""
    cut = repeated_bytes(docs, 50, carry=tuple(c for c in docs.columns if c != "text"))
    left = F.expr("coalesce(try_validate_utf8(cast(kept AS string)), replace(make_valid_utf8(cast(kept AS string)), '\uFFFD', ''))")
    return cut.withColumn("left", left).select(*[
        F.when((F.col("n_bytes") > 0) | F.col("row.n_chars").isNotNull(), F.col("left")).alias(c) if c == "text"
        else F.when(F.size("spans") > 0, F.length("left")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return minimum_bin_slack(token_pieces(docs, 2048), 2048)


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("repeated_passages", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No stage can be stated in SQL: learned rules, a tokenizer and a packing
#: heuristic decide the rows. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope() as made:
            docs = made.keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
