"""CSV with inferred types and rejected rows; tables published by a manifest."""

import pytest
from pyspark.sql import functions as F

from wardstats.sources import files as A


def _csv(folder, text):
    (folder / "a.csv").write_text(text)
    return str(folder)


def test_types_are_inferred_and_bad_rows_kept_apart(spark, tmp_path):
    good = "".join(f"{i},{i}.5,2024-01-{i % 28 + 1:02d},2024-01-01 10:{i % 60:02d}:00,true,w{i}\n" for i in range(60))
    path = _csv(tmp_path, "id,x,day,at,flag,name\n" + good + "x1,1.0,2024-01-01,2024-01-01 00:00:00,true,bad id\n"
                "70,1.0,2024-01-01\n71,1,2024-01-01,2024-01-01 00:00:00,true,a,b\n,,,,,\n")
    rows, rejects = A.read_csv_checked(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == [
        ("id", "bigint"), ("x", "double"), ("day", "date"), ("at", "timestamp_ntz"), ("flag", "boolean"), ("name", "string")]
    assert rows.count() == 61 and rows.filter("id IS NULL AND name IS NULL").count() == 1
    got = {r["_rejected"].split(",")[0]: list(r["_columns"]) for r in rejects.collect()}
    assert got == {"x1": ["id"], "70": [], "71": []}


def test_given_schema_and_empty_file(spark, tmp_path):
    rows, rejects = A.read_csv_checked(spark, _csv(tmp_path, "id,x\n"), "id int, x double")
    assert rows.count() == 0 and rejects.count() == 0 and rows.schema["id"].dataType.simpleString() == "int"
    assert {f.dataType.simpleString() for f in A.read_csv_checked(spark, str(tmp_path))[0].schema.fields} == {"string"}


def test_publish_is_atomic_and_keeps_the_last_versions(spark, tmp_path):
    path = str(tmp_path / "comparison")
    for n in (3, 5, 7, 9):
        A.publish(spark.range(n), path)
        assert A.read_published(spark, path).count() == n
    assert len([p for p in (tmp_path / "comparison").iterdir() if p.is_dir()]) == 2
    # a writer that fails half way leaves the last version as it was
    with pytest.raises(Exception):
        A.publish(spark.range(100).select(F.raise_error(F.lit("lost")).cast("string").alias("id")), path)
    assert A.read_published(spark, path).count() == 9
    # a write that is tried again adds nothing to it
    A.publish(spark.range(11), path)
    assert A.read_published(spark, path).count() == 11
