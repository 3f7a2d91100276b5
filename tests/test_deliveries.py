"""Rewritten files, versions of a book in and between batches, replays, null marks, and the tiers of parts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import search_text as st
from tessera.streaming.delivery import stream_index

FIELDS, GRAMS = ["title", "annotation"], ["title"]
SCHEMA = "book_id long, update_id long, title string, annotation string"


def held(spark, root):
    index = ix.read_index(spark, root)
    rows = sorted((r.term, r.book_id) for r in index.postings.filter("field = 'title'").collect())
    books = {r.book_id: r.dl for r in index.books.collect()}
    assert index.books.count() == len(books) == index.state["books"]
    assert index.n_books == sum(n > 0 for n in books.values()) and index.state["forms"] == sum(books.values()) == index.postings.count()
    assert sorted(map(tuple, index.vocabulary().collect())) == sorted(map(tuple, index.postings.groupBy("field", "term").agg(F.count("*").alias("n")).collect()))
    return rows


@pytest.fixture
def give(spark, tmp_path):
    root = str(tmp_path / "index")

    def deliver(*books, **of):
        return ix.deliver(spark.createDataFrame(list(books), SCHEMA), root, FIELDS, GRAMS, **of)

    deliver.root = root
    return deliver


def test_newest_version_wins(spark, give):
    give((1, 1, "red fox", None), (1, 2, "old fox", None), (2, None, "blue", "x"), (3, 5, None, None))
    assert held(spark, give.root) == [("blue", 2), ("fox", 1), ("old", 1)]
    state = give((2, None, "green", None), (1, 1, "late", None), (3, None, "late", None))  # older versions of 1 and 3; another of 2
    assert held(spark, give.root) == [("fox", 1), ("green", 2), ("old", 1)] and state["mark"] == 5
    assert [(p["books"], p["gone"]) for p in state["parts"]] == [(3, 0), (1, 1)]
    assert [r.book_id for r in st.match(ix.read_index(spark, give.root), "blue").collect()] == []


def test_null_marks_and_empty_batches(spark, give):
    assert give((1, None, "a", None))["mark"] is None and give((2, None, "b", None))["mark"] is None
    before = ix.read_state(spark, give.root)
    assert give()["action"] == "skipped" and ix.read_state(spark, give.root) == before
    assert held(spark, give.root) == [("a", 1), ("b", 2)]


def test_replayed_batches_write_nothing(spark, give):
    give((1, 1, "one", None), stream="s", number=0)
    second = give((1, 2, "two", None), (2, 2, "three", None), stream="s", number=1)
    for number, books in ((1, [(1, 9, "again", None)]), (0, [(1, 1, "one", None)])):
        assert give(*books, stream="s", number=number)["action"] == "skipped"
    assert ix.read_state(spark, give.root) == second and held(spark, give.root) == [("three", 2), ("two", 1)]
    assert give((3, 1, "other", None), stream="t", number=0)["version"] == 3  # another stream has its own numbers


def test_parts_grow_with_the_logarithm(spark, give, monkeypatch):
    """Parts after many deliveries, one of which replaces an earlier book each time, against one build of the final books."""
    monkeypatch.setattr(ix, "FANOUT", 2)
    books, most = {}, 0
    for k in range(9):
        fresh = [(k, 10 * k, f"word{k} both", "x"), (k // 2, 10 * k + 1, f"new{k} both", None)]
        books |= {b[0]: b for b in sorted(fresh, key=lambda b: b[1])}
        state = give(*fresh)
        most = max(most, len(state["parts"]))
    assert most <= 4  # one of each level, and one
    rows = held(spark, give.root)
    whole = str(give.root) + "-whole"
    docs = spark.createDataFrame(list(books.values()), SCHEMA)
    ix.build_index(docs, lambda since: docs, whole, FIELDS, GRAMS)
    assert rows == held(spark, whole)
    one, other = ix.read_index(spark, give.root), ix.read_index(spark, whole)
    assert one.n_books == other.n_books and one.average_size == other.average_size
    score = lambda i: sorted((r.book_id, round(r.score, 9)) for r in st.bm25(i, "both new8").collect())
    assert score(one) == score(other) != []


def test_rewritten_files(spark, tmp_path):
    """The same number of books and the same mark with other texts: a full build; untouched files: nothing to do."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "index")

    def build(*books):
        if books:
            spark.createDataFrame(list(books), SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
        given = spark.read.schema(SCHEMA).parquet(folder)
        return ix.build_index(given, lambda since: given if since is None else given.filter(F.col("update_id") > since), root, FIELDS, GRAMS, files=[folder])

    assert build((1, 1, "fox", None), (2, 2, "hen", None))["action"] == "full" and build()["action"] == "skipped"
    assert build((1, 1, "hen", None), (2, 2, "fox", None))["action"] == "full"
    assert [r.book_id for r in st.match(ix.read_index(spark, root), "fox").collect()] == [2]
    assert build((1, 1, "hen", None), (2, 2, "fox", None), (3, 3, "cow", None))["action"] == "incremental"
    assert held(spark, root) == [("cow", 3), ("fox", 2), ("hen", 1)]


def test_many_words_and_phrases(spark, give):
    words = " ".join(f"w{k}" for k in range(90))
    give((1, 1, words, "a b a b a"), (2, 2, words.replace("w7 ", ""), "b a a b"), (3, 3, "w1", "a"))
    index = ix.read_index(spark, give.root)
    for text in (words, words + " w1 w2"):
        assert [r.book_id for r in st.match(index, text).collect()] == [r.book_id for r in st.bm25(index, text).collect()] == [1]
        assert sorted(r.book_id for r in st.bm25(index, text, op="prefix").collect()) == [1, 2]  # w7 begins w70
    count = lambda text: sorted(map(tuple, st.phrase(index, ["annotation"], text).collect()))
    assert count("a b") == [(1, 2), (2, 1)] and count("a b a") == [(1, 2)] and count("a a") == [(2, 1)] and count("b b") == [] and count("a") == [(1, 3), (2, 2), (3, 1)]
    assert sorted(map(tuple, st.phrase(index, FIELDS, "w1 w2").collect())) == [(1, 1, 0), (2, 1, 0)]
    assert st.ranked({"text": "w1"}, index) is not None and st.ranked({"and": [{"text": "w1"}]}, index) is None and st.ranked({"text": "w1x", "op": "substring"}, index) is None


def test_stream_replays(spark, tmp_path):
    """Versions of one book in one micro-batch, and a checkpoint that lost its commit: the batch runs again and changes nothing."""
    folder, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "checkpoint")

    def run():
        stream_index(spark, folder, SCHEMA, root, checkpoint, FIELDS, GRAMS).awaitTermination()

    for book in ((1, 1, "red fox", "x"), (1, 2, "old fox", "y")):
        spark.createDataFrame([book], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert held(spark, root) == [("fox", 1), ("old", 1)]
    before = ix.read_state(spark, root)
    for name in (tmp_path / "checkpoint" / "commits").iterdir():
        name.unlink()
    run()
    assert ix.read_state(spark, root) == before
