"""The catalog queries against DuckDB, and literal cases for text and content rules."""

import duckdb
import pytest

from tessera.functions.text import stem_word, strip_tags, tokens
from tessera.plans.registry import ORACLE_SQL, QUERIES
from tessera.sources.content import book_metadata, normalise_reviews

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def rows(values):
    def plain(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    assert rows(found.select(*columns).collect()) == rows(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


#: Own examples, their stems worked out by the rules: endings cut within the region behind the first vowel, the longest first.
STEMS = {
    "окно": "окн", "окном": "окн", "окнами": "окн", "зимой": "зим", "зимами": "зим", "деревня": "деревн", "деревнях": "деревн",
    "светлого": "светл", "светлыми": "светл", "плывший": "плывш", "строила": "стро", "смотревшись": "смотревш", "умывшись": "ум",
    "гордость": "гордост", "независимость": "независим", "нежнейший": "нежн", "длинный": "длин", "площадь": "площад", "ёлками": "елк",
    "рек": "рек", "да": "да", "window": "window", "Übung": "übung", "42": "42",
}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_tokens_and_tags(spark):
    df = spark.createDataFrame([("Дюна 2, часть 3", "<p>a&amp;b &#1078;&#x41; &unknown;</p>"), (None, None), ("", "&LT;i&gt; &#38;lt; &amp;amp;  &#0; &#xD800; &; & x")], "t string, h string")
    assert [tuple(r) for r in df.select(tokens(df.t), strip_tags(df.h)).collect()] == [(["дюна", "2", "часть", "3"], "a&b жA &unknown;"), ([], ""), ([], "<i> &lt; &amp; &#0; &#xD800; &; & x")]


def test_book_file_in_another_charset(spark):
    xml = '<?xml version="1.0" encoding="windows-1251"?><FictionBook><description><title-info><annotation><p>Раз</p><p>Два</p></annotation><translator><first-name>Анна</first-name><last-name>Ли</last-name></translator></title-info><publish-info><year>1999</year></publish-info></description><body><section><title><p>Глава</p></title><section><title>Нет</title></section>текст</section></body></FictionBook>'
    r = book_metadata(spark.createDataFrame([(1, bytearray(xml.encode("cp1251")))], "book_id long, content binary")).first()
    assert (r.annotation, r.publish_year, r.translators, r.chapters, r.pages) == ("Раз\nДва", 1999, ["Ли Анна"], ["Глава"], 1)


def test_reviews(spark):
    data = '[{"Nick":"b","Date":"2","Body":"x<br/>y"},{"time":"1","text":" z "},{"name":"c","text":""}]'
    found = normalise_reviews(spark.createDataFrame([(1, data), (2, "{bad")], "id int, data string"), "id", "data").collect()
    assert [(r.name, r.text, r.place) for r in found] == [("Аноним", "z", 1), ("b", "x\ny", 2)]
