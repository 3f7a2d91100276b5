"""A build reads its source once; grams are stored as lists of books; books, links and annotations meet in one aggregate."""

from pyspark.sql import functions as F

from tessera.operators import index as ix

FIELDS, GRAMS = ["title", "annotation"], ["title"]
SCHEMA = "book_id long, update_id long, title string, annotation string"
TITLES = ["a fox, a fox", "ab", "", None, "Тихие берега", "𐐀𐐁𐐂 ßx", "old Fox old", "x" * 50, "café noir"]


def books(spark, n, first=0):
    return spark.createDataFrame([(first + k, first + k, TITLES[k % len(TITLES)], f"берег {k} {k}") for k in range(n)], SCHEMA)


def held(df):
    return sorted(map(tuple, df.select("field", "gram", "book_id").collect()))


def test_lists_hold_every_gram(spark, tmp_path, monkeypatch):
    root, docs = str(tmp_path / "index"), books(spark, 300)
    monkeypatch.setattr(ix, "BLOCK_LETTERS", 400)  # several blocks
    ix.build_index(docs, lambda since: docs, root, FIELDS, GRAMS)
    index = ix.read_index(spark, root)
    pairs, rows = held(index.grams), spark.read.parquet(f"{root}/grams").count()
    assert pairs == held(ix.grams(docs, GRAMS)) and rows < len(pairs) / 3
    assert held(index.grams.filter("gram = 'fox'")) == [p for p in pairs if p[1] == "fox"] != []


def test_lists_of_merged_parts(spark, tmp_path, monkeypatch):
    """Deliveries that replace books, merged: as the grams of the newest books."""
    root = str(tmp_path / "index")
    monkeypatch.setattr(ix, "FANOUT", 2)
    monkeypatch.setattr(ix, "LIST_BOOKS", 20)
    for batch in (books(spark, 50), books(spark, 30, 40), books(spark, 9).withColumn("update_id", F.lit(900).cast("long")).withColumn("title", F.lit("another"))):
        state = ix.deliver(batch, root, FIELDS, GRAMS)
    assert state["books"] == 70 and len(state["parts"]) == 2
    want = books(spark, 70).filter("book_id between 9 and 39").unionByName(books(spark, 30, 40)).unionByName(books(spark, 9).withColumn("title", F.lit("another")))
    assert held(ix.read_index(spark, root).grams) == held(ix.grams(want, GRAMS))


def test_source_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(title):
        read.add(1)
        return title

    docs = books(spark, 100).withColumn("title", seen("title"))
    ix.build_index(books(spark, 100), lambda since: docs, str(tmp_path / "index"), FIELDS, GRAMS)
    assert read.value == 100


def test_rows_of_a_source(spark):
    own = spark.createDataFrame([(1, 5, "one"), (2, 6, "two"), (3, 7, None)], "book_id long, update_id long, title string")
    names = spark.createDataFrame([(1, 8, 1, "b"), (1, 7, 0, "a"), (1, 3, 1, "c"), (2, 1, 0, None), (9, 1, 0, "lost")], "book_id long, id long, ord int, name string")
    words = spark.createDataFrame([(1, "w", 0), (2, "z", 0), (2, "y", 1)], "book_id long, word string, ord int")
    notes = spark.createDataFrame([(2, "note"), (8, "lost")], "book_id long, annotation string")
    got = lambda since: {r.book_id: (r.update_id, r.title, r.names or "", r.words or "", r.annotation) for r in ix.source_rows(own, {"names": (names, "id", "name"), "words": (words, "word", "word")}, notes, since).collect()}
    every = {1: (5, "one", "a c b", "w", None), 2: (6, "two", "", "z y", "note"), 3: (7, None, "", "", None)}
    assert got(None) == every and got(5) == {k: v for k, v in every.items() if k > 1}
