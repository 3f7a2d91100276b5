"""BPE on null ids and texts, repeated rows, a very long text, clashing columns and an empty table, against the library."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def library(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_edge_rows_equal_the_library(spark, tmp_path):
    texts = [None, "", " ", "naïve  café\n\n\tx", "<|endoftext|> a", "word " * 60_000, "\U0001f600é" * 50]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (None, None), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit("i"), "decoded": F.lit(1), "n_tokens": F.lit(2)})
    done = bpe.encode(docs, PATH, decoded="decoded")
    assert sorted(done.columns) == sorted(docs.columns) and done.filter("n_tokens <> 2").isEmpty()
    got = sorted(((r.doc_id, r.text, bytes(r.ids), r.decoded) for r in done.collect()), key=repr)
    assert got == sorted(((k, t, *library(t)) for k, t in rows), key=repr)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    told = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.op8_bpe(spark, str(tmp_path)).collect()}
    assert told == {(k, len(library(t)[0]) // 4, hashlib.sha256(library(t)[0]).hexdigest()) for k, t in rows}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, decoded="decoded").collect() == []
