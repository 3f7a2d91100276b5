"""Rules of book files: tags in any case and with prefixes, which title is a chapter's, charsets, years."""

from tessera.sources.content import book_metadata


def read(spark, *files):
    df = spark.createDataFrame([(k, bytearray(x.encode() if isinstance(x, str) else x)) for k, x in enumerate(files)], "book_id long, content binary")
    return sorted(book_metadata(df).collect(), key=lambda r: r.book_id)


def test_chapters(spark):
    body = "<body>{}</body>"
    found = read(
        spark,
        body.format("<section><title><p>One</p></title><poem><title>Song</title></poem></section><SECTION id='x'><TITLE><p>Up &amp; <b>away</b></p></TITLE></SECTION>"),
        body.format("<section><section><title>inner</title></section><title>late</title></section><section>no title</section>"),
        body.format("<fb:section><fb:title>\n A\n <p>b</p></fb:title><section><title>below</title></section></fb:section><section/><section><title> </title></section><section><title>Last</title></section>"),
        "no body at all",
        body.format("<section><title>open"),
    )
    assert [r.chapters for r in found] == [["One", "Up & away"], [], ["A b", "Last"], [], []]


def test_tags_in_any_case(spark):
    xml = "<FictionBook><Description><Title-Info><Annotation><P>first</P><p>second &lt;</p></Annotation><FB:Translator><First-Name>Ann</First-Name><LAST-NAME>Lee</LAST-NAME></FB:Translator><src-lang>EN</src-lang></Title-Info><PUBLISH-INFO><Publisher>P</Publisher><YEAR>1999</YEAR></PUBLISH-INFO></Description><Body>a  b</Body></FictionBook>"
    r = read(spark, xml)[0]
    assert (r.annotation, r.translators, r.src_lang, r.publisher, r.publish_year, r.letters, r.words, r.pages) == ("first\nsecond <", ["Lee Ann"], "EN", "P", 1999, 3, 2, 1)


def test_charsets_and_years(spark):
    head = "<?xml version='1.0' ENCODING = 'Windows-1251'?><annotation/><title-info><annotation>Раз</annotation></title-info><publish-info><year>{}</year></publish-info>"
    odd = head.replace("Windows-1251", "no-such-charset")
    found = read(spark, head.format("19999").encode("cp1251"), odd.format("212").encode(), b"")
    assert [(r.annotation, r.publish_year) for r in found] == [("Раз", None), ("Раз", 212), (None, None)]
