"""Tables of queries that share words: books are found once for each distinct word, not once for each query."""

from tessera.operators import index as ix
from tessera.operators import search_text as st

FIELDS = ["title", "annotation"]


def test_shared_words(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "index"), {}
    docs = spark.createDataFrame([(k, k, f"come com{k} co{k} берега", "берег" if k % 2 else None) for k in range(60)], "book_id long, update_id long, title string, annotation string")
    ix.build_index(docs, lambda since: docs, root, FIELDS, ["title"])
    index, write = ix.read_index(spark, root), st.written

    def counted(df, name):
        seen[name] = (out := write(df, name)).count()
        return out

    monkeypatch.setattr(st, "written", counted)
    asked = spark.createDataFrame([(q, ("co", "Com, co", "com5 бере", "zz co", "co6 co co6")[q % 5]) for q in range(500)], "query_id long, text string")
    found = st.search(asked, index, "title", prefix=True).collect()
    every, begun = set(range(60)), {5, *range(50, 60)}
    want = {0: every, 1: every, 2: begun, 3: set(), 4: {6}}
    assert sorted((r.query_id, r.book_id) for r in found) == sorted((q, b) for q in range(500) for b in want[q % 5])
    assert max(seen.values()) <= 900  # words of queries, and terms and books of words; a row for each query and term would be tens of thousands
    asked = spark.createDataFrame([(q, ("берегами", "come берег", "come com7 x")[q % 3]) for q in range(30)], "query_id long, text string")
    found = st.search(asked, index).collect()
    assert sorted((r.query_id, r.book_id) for r in found) == sorted((q, b) for q in range(30) if q % 3 < 2 for b in range(60))
