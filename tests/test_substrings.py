"""Substrings by vocabulary and positions against a plain search of the normalised texts."""

import random

from tessera.functions.text import query_words
from tessera.operators import index as ix
from tessera.operators import search_text as st


def test_against_plain_search(spark, tmp_path, monkeypatch):
    dice = random.Random(3)
    words = ["ana", "banana", "an", "nab", "Ёж", "ab", "aba", "Grün", "x1"]
    texts = [None, "", "...", "banana"] + [dice.choice([" ", ", ", "\n"]).join(dice.choices(words, k=dice.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(k, k, t, "banana banana") for k, t in enumerate(texts)], "book_id long, update_id long, title string, annotation string")
    root = str(tmp_path / "index")
    ix.build_index(docs, lambda since: docs, root, ["title", "annotation"], ["title"])
    index = ix.read_index(spark, root)
    plain = [" ".join(query_words(t or "")) for t in texts]
    asked = ["nan", "ana ban", "na na", "an an an", "b a", "еж ab", "n gru", "ab absent", "ana ana ana"]
    for broadcast in (True, False):
        if not broadcast:
            monkeypatch.setattr(st, "BROADCAST_BOOKS", -1)
            monkeypatch.setattr(st, "BROADCAST_FORMS", -1)
        for text in asked if broadcast else asked[1:4]:
            found = sorted(r.book_id for r in st.substring(index, "title", text).collect())
            assert found == [k for k, t in enumerate(plain) if text in t], text


def test_no_text_and_no_gram_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, 1, "red fox runs", None)], "book_id long, update_id long, title string, annotation string")
    root = str(tmp_path / "index")
    ix.build_index(docs, lambda since: docs, root, ["title", "annotation"], ["title"])
    plan = st.substring(ix.read_index(spark, root), "title", "ed fox ru")._jdf.queryExecution().optimizedPlan().toString()
    assert "gram#" not in plan and "annotation" not in plan.replace("field", "")
