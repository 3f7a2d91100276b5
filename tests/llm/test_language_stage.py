"""The pipeline's language stage rejects by the model, keeps clean documents and columns, and works without labels."""

import base64
import random

from pyspark.sql import functions as F

from tessera.llm import language

DATA = "/root/testdata/sf0.001"


def test_stage(spark):
    random.seed(9)
    raw = random.randbytes(3000)
    junk = [raw.hex(), base64.b64encode(raw).decode(), "日本語の文書です" * 40, "12 34", None]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    more = spark.createDataFrame([(10**6 + i, None, t) for i, t in enumerate(junk)], docs.schema)
    found = language.language_stage(spark, docs.unionByName(more).withColumn("score", F.lit("own")), DATA)
    assert found.columns == ["doc_id", "lang", "text", "score"]
    rows = found.collect()
    assert {r.score for r in rows} == {"own"}
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if language.lettered(r.text)}


def test_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "some words"), (2, None, "12"), (3, None, None)], "doc_id long, lang string, text string")
    assert [r.doc_id for r in language.language_stage(spark, docs, DATA).collect()] == [1]
