"""Whole texts and passages in the text queries: against brute force, beyond the first line, its 200 characters and three words."""

import re

import pytest

from tessera.plans.registry import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    long = "word " * 60
    texts = [(1, long + "therrtail finding the end"), (2, "first line\nsecond therrmore\nbring them on"), (3, "plain words only"), (4, None), (5, ""), (6, "alpha beta gamma delta"), (7, "alpha beta gamma omega"), (8, "Alpha, beta\n" + long + "GAMMA delta")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma omega"), (3, "alpha beta gamma sigma")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}


def test_grams_prefix_and_substring(spark, folder):
    d, words = folder
    joined = {i: " ".join(w) for i, w in words.items()}
    found = {(r.book_id, r.gram) for r in QUERIES["index_grams_whole"](spark, d).collect()}
    assert found == {(i, t[k : k + 3]) for i, t in joined.items() for k in range(len(t) - 2)}
    assert {r.book_id for r in QUERIES["text_prefix_whole"](spark, d).collect()} == {i for i, w in words.items() if any(x.startswith("therr") for x in w)} == {1, 2}
    assert {r.book_id for r in QUERIES["text_substring_whole"](spark, d).collect()} == {i for i, t in joined.items() if "ing th" in t} == {1, 2}


def test_postings_and_passages(spark, folder):
    d, words = folder
    found = {(r.field, r.book_id, r.term) for r in QUERIES["index_postings_whole"](spark, d).collect()}
    assert ("title", 1, "therrtail") in found and {(i, t) for f, i, t in found if f == "annotation"} == {(i, x) for i, w in words.items() for x in w}
    assert {(r.query_id, r.book_id) for r in QUERIES["batch_search_whole"](spark, d).collect()} == {(1, 6), (1, 8), (2, 7)}
