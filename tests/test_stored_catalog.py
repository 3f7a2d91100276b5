"""A stored catalog: written once for each state of its files, whole or not at all; tables of a wrong kind are errors."""

import shutil

import pytest
from pyspark.sql import functions as F

from tessera.plans import registry
from tessera.sources.catalog import table
from tessera.sources.storage import file_manifest, kept

DATA = "/root/testdata/sf0.001"


def test_kept_follows_the_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    made = []

    def frames():
        made.append(1)
        return {"doubled": (spark.read.parquet(folder).select((F.col("id") * 2).alias("n")), ["n"])}

    def numbers():
        return sorted(r.n for r in kept(spark, "numbers", frames, [folder])["doubled"].collect())

    spark.range(3).write.parquet(folder)
    assert numbers() == numbers() == [0, 2, 4] and len(made) == 1
    spark.range(4).write.mode("overwrite").parquet(folder)
    assert numbers() == [0, 2, 4, 6] and len(made) == 2

    def dies():
        raise RuntimeError("lost")

    spark.range(5).write.mode("overwrite").parquet(folder)
    with pytest.raises(RuntimeError):
        kept(spark, "numbers", dies, [folder])
    assert numbers() == [0, 2, 4, 6, 8] and len(made) == 3


def test_manifest(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(3).coalesce(1).write.parquet(str(folder))
    before = file_manifest(spark, [str(folder)])
    assert before == file_manifest(spark, [str(folder)]) and before["files"] == 1 and before["bytes"] > 0
    spark.range(3).coalesce(1).write.mode("append").parquet(str(folder))
    after = file_manifest(spark, [str(folder)])
    assert after["files"] == 2 and after["digest"] != before["digest"]


def test_changed_overrides_reach_the_queries(spark, tmp_path):
    """Another table of events, with as many rows: the answers are those of the new one."""
    folder = tmp_path / "data"
    shutil.copytree(DATA, folder)
    before = registry.QUERIES["total"](spark, str(folder)).first().total
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("value", F.lit(100.0)).withColumn("event_type", F.lit("error"))
    events.write.mode("overwrite").parquet(str(folder / "changed"))
    (folder / "events.parquet").unlink()
    (folder / "changed").rename(folder / "events.parquet")
    after = registry.QUERIES["total"](spark, str(folder)).first().total
    assert after < before


def test_columns_of_another_kind(spark, tmp_path):
    spark.createDataFrame([("a", "t")], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(str(tmp_path / "d2" / "documents.parquet"))
    with pytest.raises(ValueError, match="doc_id is string"):
        table(spark, str(tmp_path), "documents")
    with pytest.raises(ValueError, match="lacks text"):
        table(spark, str(tmp_path / "d2"), "documents")
