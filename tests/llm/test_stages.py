"""All stages of the pipeline on null, empty, repeated and very long rows and clashing names, down to the packed places."""

import base64
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import language, quality

NAMES = "score lang_pred bits_per_byte kept base_failed n_words m_ component_id sig bands set_key group n key part ids piece start length ids_crc32 sequence_id offset cell rank base".split()
VOCAB = "the of and to in is that with stone river garden under over light slow green paper window table house morning people water letter".split()


def sentence(rng, n):
    return "\n".join(" ".join(rng.choice(VOCAB) for _ in range(12)) for _ in range(n // 12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(7), str(tmp_path_factory.mktemp("stages"))
    texts = [sentence(rng, 120) for _ in range(40)]
    near = texts[3].split(" ")
    near[50] = "changed"
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(100, texts[3], None), (101, " ".join(near), "en"), (102, sentence(rng, 30_000), "en")]
    rows += [(5, texts[5], "en"), (None, sentence(rng, 96), "en"), (None, None, "en"), (200, None, None), (201, "", None), (202, "12 34 56", "en")]
    junk = rng.randbytes(4000)
    rows += [(203, junk.hex(), None), (204, base64.b64encode(junk).decode(), None), (205, "same words here " * 60, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES))).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_each_stage_and_the_whole(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    left = {(i, t) for i, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, d), name)
        assert docs.columns == columns
        found = docs.collect()
        assert {tuple(r[n] for n in NAMES) for r in found} == {tuple(range(len(NAMES)))}
        if name == "language_id":
            left = {(i, t) for i, t in left if t and any(map(str.isalpha, t)) and i not in (203, 204)}
        elif name == "quality_rules":
            con = duckdb.connect()
            documents = docs_of(left)
            con.register("documents", documents)
            keeps = {r[0] for r in con.sql(f"select doc_id from ({quality.ORACLE_SQL}) where kept").fetchall()}
            left = {(i, t) for k, (i, t) in enumerate(sorted(left, key=str)) if k in keeps}
            assert (205, "same words here " * 60) not in left
        else:
            left = {(i, t) for i, t in left if i not in (100, 101)}
        assert {(r.doc_id, r.text) for r in found} == left
    assert len([r for r in found if r.doc_id == 5]) == 2  # all rows of an id that stays

    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), corpus_pipeline.run(spark, d).collect()
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    held: dict = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append(r.length)
        assert r.start == r.piece * 4096
    assert {i: sum(n) for i, n in held.items()} == {i: n * (2 if i == 5 else 1) for i, n in tokens.items()}
    ends: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        ends[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in pieces)
    assert -(-total // 4096) <= len(ends) <= -(-total // 4096) + 1


def docs_of(left):
    """Rows as a table of (place, text)."""
    import pyarrow as pa

    ordered = sorted(left, key=str)
    return pa.table({"doc_id": pa.array(range(len(ordered)), pa.int64()), "text": pa.array([t for _, t in ordered], pa.string())})


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_rows(spark, folder):
    """Null and repeated ids, ties between equal languages, clashing names, and no rows."""
    model = language.train(spark.createDataFrame([(1, "b", "same text"), (2, "a", "same text"), (None, "c", "other"), (3, None, "x")], "doc_id long, lang string, text string"))
    assert model["langs"] == ["a", "b"]
    docs = spark.createDataFrame([(1, "same", "own"), (1, "same", "own"), (None, "text", "own"), (2, None, "own"), (3, "", "own"), (4, "same " * 100_000, "own")], "doc_id long, text string, score string")
    found = language.identify(docs, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in found) == [("1", "a"), ("1", "a"), ("2", "und"), ("3", "und"), ("4", "a"), ("None", "a")]
    assert all(0 <= r.score <= 1 for r in found) and {np.round(r.score, 6) for r in found if r.lang_pred == "a"} == {0.5}
    assert language.identify(docs.limit(0), model).count() == 0
