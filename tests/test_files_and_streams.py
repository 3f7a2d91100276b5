"""Book and review files, names, deliveries as a stream, and an index whose builds die."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import index_text, stem_text
from tessera.operators import index as ix
from tessera.operators import search_text as st
from tessera.sources.catalog import author_name, effective, genre_label
from tessera.sources.content import book_metadata, read_book_files, read_reviews
from tessera.streaming.delivery import stream_index

FIELDS, GRAMS = ["title", "annotation"], ["title"]


def test_files(spark, tmp_path):
    fb2 = "<FictionBook><description><title-info><translator><middle-name>M.</middle-name><last-name>Last</last-name><first-name>First</first-name></translator><translator><nickname>nick</nickname></translator></title-info></description></FictionBook>"
    (tmp_path / "books" / "arc").mkdir(parents=True)
    (tmp_path / "books" / "arc" / "a b+c.fb2").write_text(fb2)
    (tmp_path / "books" / "arc" / "other.fb2").write_text(fb2)
    books = spark.createDataFrame([(1, "arc", "a b+c.fb2"), (2, "arc", "none.fb2")], "book_id long, archive string, file_name string")
    found = book_metadata(read_book_files(spark, str(tmp_path / "books"), books)).collect()
    assert [(r.book_id, r.translators) for r in found] == [(1, ["Last First M.", "nick"])]
    for folder in ("arc", "elsewhere"):
        (tmp_path / "reviews" / folder).mkdir(parents=True)
        (tmp_path / "reviews" / folder / "a b+c.fb2").write_text(json.dumps([{"name": folder, "text": "fine\nindeed", "time": "1"}]))
    assert [(r.book_id, r.name, r.text, r.place) for r in read_reviews(spark, str(tmp_path / "reviews"), books).collect()] == [(1, "arc", "fine\nindeed", 1)]


def test_names_labels_and_overrides(spark):
    names = spark.createDataFrame([(" Unknown authors ", None, None), ("Last", "First", " "), (None, "First", None), (None, None, None), (" A", None, "B ")], "last_name string, first_name string, middle_name string")
    found = [tuple(r) for r in names.select(author_name("page"), author_name("facet"), author_name("list")).collect()]
    assert found == [("Unknown author",) * 3, ("Last First", "Last First", "Last First"), ("First", "Unknown author", "First"), ("Unknown author",) * 3, ("A B", "A  B", "A  B")]
    genres = spark.createDataFrame([("t", "a", "c"), ("", "a", "c"), (None, "", "c")], "title string, alias string, code string")
    assert [r[0] for r in genres.select(genre_label(F.col("title"), F.col("alias"), F.col("code"))).collect()] == ["t", "a", "c"]
    books = spark.createDataFrame([(1, "b1", ".x", True), (2, "b2", ".x", False), (3, "b3", ".x", False)], "book_id long, base_name string, ext string, deleted boolean")
    given = spark.createDataFrame([(1, False, 3), (2, None, 4), (9, True, 1)], "book_id long, deleted boolean, rate int")
    assert sorted((r.book_id, r.deleted, r.file_name, r.source_rate) for r in effective(books, given).collect()) == [(1, False, "b1.x", 3), (2, False, "b2.x", 4), (3, False, "b3.x", None)]


def test_forms(spark):
    df = spark.createDataFrame([(1, "Окна, окно и window Окна"), (2, None), (3, "")], "book_id long, t string")
    assert [r[0] for r in df.select(index_text(F.col("t"))).collect()] == [["окна", "окн", "окно", "и", "window"], [], []]
    assert sorted(tuple(r) for r in stem_text(df, "book_id", "t").collect()) == [(1, "окн окн и window окн"), (2, ""), (3, "")]


def rows(*books):
    return [(i, u, t, a) for i, u, t, a in books]


SCHEMA = "book_id long, update_id long, title string, annotation string"


def test_stems_prefixes_and_scopes(spark, tmp_path):
    docs = spark.createDataFrame(rows((1, 1, "Тихие берега", "море"), (2, 2, "Берегом реки", None), (3, 3, "café noir", "берег"), (4, 4, "Die grüne, Ecke", "x")), SCHEMA)
    root = str(tmp_path / "index")
    state = ix.build_index(docs, lambda since: docs, root, FIELDS, GRAMS)
    index = ix.read_index(spark, root)
    ids = lambda df: sorted(r.book_id for r in df.collect())
    assert state["action"] == "full" and index.n_books == 4
    assert ids(st.match(index, "берег")) == [1, 2, 3] and ids(st.match(index, "берегами", "title")) == [1, 2]
    assert ids(st.match(index, "берег море")) == [1] and ids(st.match(index, "берег море", "title")) == []
    assert ids(st.match(index, "берегами ре", op="prefix")) == [2]
    assert ids(st.phrase(index, ["title"], "тихие берега")) == [1] and ids(st.phrase(index, ["title"], "берега тихие")) == []
    assert ids(st.substring(index, "title", "CAFÉ n")) == [3] and ids(st.substring(index, "title", "grune; eck")) == [4]
    assert ids(st.unindexed(docs, ["title"], "CAFE, noir;")) == [3]
    asked = spark.createDataFrame([(1, "берега море"), (2, "cafe"), (3, "absent берег"), (4, "x ecke")], "query_id long, text string")
    assert sorted(tuple(r) for r in st.search(asked, index).collect()) == [(1, 1), (2, 3), (4, 4)]
    with pytest.raises(ValueError):
        st.substring(index, "title", "a,")
    with pytest.raises(ValueError):
        st.match(index, " ,; ")


def test_a_build_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    docs = spark.createDataFrame(rows((1, 1, "one", "a")), SCHEMA)
    more = docs.unionByName(spark.createDataFrame(rows((2, 2, "two", "b")), SCHEMA))
    later = lambda since: more if since is None else more.filter(F.col("update_id") > since)
    ix.build_index(docs, lambda since: docs, root, FIELDS, GRAMS)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ix, "save_state", dies)
        with pytest.raises(RuntimeError):
            ix.build_index(more, later, root, FIELDS, GRAMS)
    assert ix.read_state(spark, root)["books"] == 1 and ix.read_index(spark, root).postings.filter("term = 'two'").isEmpty()
    assert ix.build_index(more, later, root, FIELDS, GRAMS)["action"] == "incremental" and not ix.read_index(spark, root).postings.filter("term = 'two'").isEmpty()


def test_deliveries(spark, tmp_path):
    """Three runs of a stream: new books, a book delivered again with other words, and the same delivery once more."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "index")

    def arrive(name, *books):
        spark.createDataFrame(rows(*books), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream_index(spark, folder, SCHEMA, root, str(tmp_path / "checkpoint"), FIELDS, GRAMS).awaitTermination()
        index = ix.read_index(spark, root)
        held = sorted((r.term, r.book_id) for r in index.postings.filter("field = 'title'").collect())
        assert index.n_books == index.sizes.count() == len({b for _, b in held})
        return held

    assert arrive("a", (1, 1, "red fox", "x"), (2, 2, "blue fox", "x")) == [("blue", 2), ("fox", 1), ("fox", 2), ("red", 1)]
    expected = [("blue", 2), ("fox", 2), ("green", 3), ("old", 1)]
    assert arrive("b", (1, 3, "old", "x"), (3, 4, "green", "x")) == expected
    assert arrive("c", (1, 3, "old", "x"), (3, 4, "green", "x")) == expected
