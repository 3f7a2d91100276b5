"""Extra columns whose names the quality stage uses itself are kept as they are."""

from pyspark.sql import functions as F

from tessera.llm import quality

DATA = "/root/testdata/sf0.001"
NAMES = "kept base_failed n_words word_chars n_symbols n_lines n_dup_lines n_stop_words n_repeat_words m_ m".split()


def test_quality_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(NAMES)))
    found = quality.quality_stage(spark, wide, DATA)
    assert found.columns == wide.columns
    rows = found.collect()
    assert {tuple(r[n] for n in NAMES) for r in rows} == {tuple(range(len(NAMES)))}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in quality.op5_quality_rules(spark, DATA).filter("kept").collect())
