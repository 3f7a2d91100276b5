"""Text leaves in trees: by every operation, inside AND, OR and NOT, and several of them."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import search_text as st

SCHEMA = "book_id long, update_id long, title string, annotation string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(1, 1, "red fox", "a sly fox"), (2, 2, "red hen", "the fox was here"), (3, 3, "foxes", "sly red"), (4, 4, None, None)]
    docs, root = spark.createDataFrame(rows, SCHEMA), str(tmp_path_factory.mktemp("index") / "i")
    ix.build_index(docs, lambda since: docs, root, ["title", "annotation"], ["title"])
    return ix.read_index(spark, root), docs


def test_leaves(index):
    index, docs = index
    ids = lambda leaf: sorted(r.book_id for r in st.found(leaf, index).collect())
    assert ids({"text": "fox"}) == [1, 2] and ids({"text": "fox", "field": "title"}) == [1] and ids({"text": "fox", "op": "prefix"}) == [1, 2, 3]
    assert ids({"text": "sly fox", "op": "phrase"}) == [1] and ids({"text": "red sly"}) == [1, 3] and ids({"text": "ED H", "field": "title", "op": "substring"}) == [2]
    tree = st.resolve({"and": [{"text": "red"}, {"not": {"or": [{"text": "hen"}, {"number": "year", "op": "eq", "value": 1}]}}]}, index)
    assert set(tree["and"][0]) == {"books"} and set(tree["and"][1]["not"]["or"][0]) == {"books"} and tree["and"][1]["not"]["or"][1] == {"number": "year", "op": "eq", "value": 1}
    scores = {r.book_id: r.score for r in st.ranked({"text": "fox", "op": "prefix"}, index).withColumn("score", F.round("score", 9)).collect()}
    assert set(scores) == {1, 2, 3}
