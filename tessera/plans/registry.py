"""All catalog queries and their SQL, by name. Orders, lines, parts and documents play the catalog's roles (sources.catalog)."""

from __future__ import annotations

import hashlib

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import FOLD_FROM, FOLD_TO, strip_tags, tokens, volume
from tessera.operators import bitmaps as bm
from tessera.operators import facets as fc
from tessera.operators import hierarchy as hi
from tessera.operators import index as ix
from tessera.operators import paging as pg
from tessera.operators import reports as rp
from tessera.operators import search_text as st
from tessera.operators.predicates import match
from tessera.sources.catalog import Catalog, group_members, orders_catalog, stored, table
from tessera.sources.content import normalise_reviews
from tessera.sources.storage import file_manifest, new_folder, shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """with overrides as (select json_extract(props, '$.k')::bigint as book_id, arg_max(value >= 50, {'a': ts, 'b': event_id}) as deleted from events
  where event_type = 'error' and json_extract(props, '$.k') is not null group by 1),
books as (
  select o_orderkey as book_id, o_orderpriority || ' ' || o_orderkey as title, upper(o_orderpriority || ' ' || o_orderkey) as search_title,
    year(o_orderdate)::int as year, floor(o_totalprice)::bigint as size, substr(o_orderpriority, 1, 1)::int as lib_rate, o_orderpriority as lang,
    '.' || lower(o_orderstatus) as ext, c_mktsegment as archive, 'b' || o_orderkey || '.' || lower(o_orderstatus) as file_name, coalesce(deleted, o_orderstatus = 'P') as deleted,
    (year(o_orderdate) * 12 + month(o_orderdate))::bigint as update_id, c_nationkey
  from orders left join customer on o_custkey = c_custkey left join overrides on book_id = o_orderkey),
names as (select p_partkey as author_id, string_split(p_name, ' ')[2] as last_name, string_split(p_name, ' ')[1] as first_name, case when p_size % 3 = 0 then p_brand end as middle_name from part),
labels_ as (select author_id, last_name, trim(concat_ws(' ', nullif(last_name, ''), nullif(first_name, ''), nullif(middle_name, ''))) as p,
  trim(last_name || ' ' || coalesce(first_name, '') || ' ' || coalesce(middle_name, '')) as f, trim(coalesce(last_name, '') || ' ' || coalesce(first_name, '') || ' ' || coalesce(middle_name, '')) as l from names),
authors as (select author_id, last_name, case when coalesce(p, '') in ('', 'unknown') then 'Unknown author' else p end as page_name, case when coalesce(f, '') in ('', 'unknown') then 'Unknown author' else f end as facet_name,
  case when l in ('', 'unknown') then 'Unknown author' else l end as list_name from labels_),
author_links as (select *, row_number() over (partition by book_id order by seq, author_id) - 1 as ord from
  (select l_orderkey as book_id, l_partkey as author_id, min(l_linenumber) as seq from lineitem group by all)),
series_links as (select *, row_number() over (partition by book_id order by seq, series_id) - 1 as ord from
  (select l_orderkey as book_id, l_suppkey as series_id, min(l_linenumber) as seq from lineitem group by all)),
keyword_links as (select *, row_number() over (partition by book_id order by seq, keyword_id) - 1 as ord from
  (select l_orderkey as book_id, p_type as keyword_id, min(l_linenumber) as seq from lineitem join part on p_partkey = l_partkey group by all)),
genres as (select 'R' || r_regionkey as genre_code, '' as parent_code, r_name as title, false as deleted from region
  union all select 'N' || n_nationkey, 'R' || n_regionkey, case when n_nationkey % 3 > 0 then n_name when n_nationkey % 2 > 0 then lower(n_name) else 'N' || n_nationkey end, n_nationkey = 17 from nation),
genre_links as (select book_id, 'N' || c_nationkey as genre_code from books where c_nationkey is not null),
user_data as (select user_id, json_extract(props, '$.k')::bigint as book_id, max((event_type = 'purchase')::int) as favorite,
  max((event_type = 'view')::int) as read, floor(arg_max(value, {'a': ts, 'b': event_id}))::bigint % 5 + 1 as rate from events group by all),
seen as (select * from books where not deleted)
"""
TOK = f"list_filter(regexp_split_to_array(translate(lower(coalesce({{}}, '')), 'ё{FOLD_FROM}', 'е{FOLD_TO}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda x: x <> '')"
TITLE = "string_split(text, chr(10))[1]"


def tok(column: str) -> str:
    return TOK.format(column)


POSTS = f"""src as (select doc_id as book_id, {TITLE} as title, text as annotation from documents),
toks as (select book_id, 'title' as field, {tok("title")} as t from src union all select book_id, 'annotation', {tok("annotation")} from src),
posts as (select distinct field, unnest(t) as term, book_id from toks)"""


#: As POSTS, over whole first lines, and body, the whole text again as a field that may hold grams.
WHOLE = f"""src as (select doc_id as book_id, string_split(text, chr(10))[1] as title, text as annotation, text as body from documents),
toks as (select book_id, 'title' as field, {tok("title")} as t from src union all select book_id, 'annotation', {tok("annotation")} from src),
posts as (select distinct field, unnest(t) as term, book_id from toks)"""


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (BASE + sql) if base else sql
        return f

    return add


CATALOG_TABLES = ("orders", "customer", "lineitem", "part", "supplier", "region", "nation", "events")


def cat_of(spark: SparkSession, d: str) -> Catalog:
    """The catalog of an input, stored once in the shared folder for each state of its files."""

    def bind() -> Catalog:
        cat = orders_catalog(spark, d)
        cat.below = hi.closure(cat.genres)
        return cat

    return stored(spark, bind, input_files(d, *CATALOG_TABLES))


def flat(rows: DataFrame) -> DataFrame:
    """Relations as texts, for the comparison with SQL."""
    return rows.withColumns({c: F.array_join(F.transform(c, lambda x: x["label"]), "; ") for c in ("authors", "genres", "keywords")})


def documents_source(spark: SparkSession, d: str) -> DataFrame:
    """book_id, update_id, title (the whole first line) and annotation (the text) of the documents."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("book_id"), F.col("doc_id").alias("update_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("annotation"))


FIELDS, GRAM_FIELDS = ["title", "annotation"], ["title"]


def input_files(d: str, *names: str) -> list[str]:
    return [f"{d}/{name}.parquet" for name in names]


def index_root(spark: SparkSession, d: str, kind: str, fields: list[str], gram_fields: list[str]) -> str:
    """Where the index of an input lies: one for each path, kind and choice of fields."""
    named = hashlib.md5("\n".join([str(ix.LAYOUT), d, *fields, "", *gram_fields]).encode()).hexdigest()
    return f"{shared_folder(spark)}/{kind}-{named}"


def _documents_index(spark: SparkSession, d: str, kind: str, source: DataFrame, fields: list[str], gram_fields: list[str]) -> ix.TextIndex:
    root = index_root(spark, d, kind, fields, gram_fields)
    since = lambda mark: spread(source if mark is None else source.filter(F.col("update_id") > mark))
    ix.build_index(source.select("book_id", "update_id"), since, root, fields, gram_fields, files=input_files(d, "documents"))
    return ix.read_index(spark, root)


def documents_index(spark: SparkSession, d: str) -> ix.TextIndex:
    """The index of the documents: built where there is none or the files were rewritten, else read; what has been added since is indexed incrementally."""
    return _documents_index(spark, d, "text-index", documents_source(spark, d), FIELDS, GRAM_FIELDS)


def body_index(spark: SparkSession, d: str) -> ix.TextIndex:
    """The words of the whole texts as a field that knows substrings."""
    return _documents_index(spark, d, "body-index", whole_source(spark, d), ["body"], ["title"])


def whole_source(spark: SparkSession, d: str) -> DataFrame:
    """book_id, title (the whole first line), annotation and body (both the text) of the documents."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("book_id"), F.col("doc_id").alias("update_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("annotation"), F.col("text").alias("body"))


SEARCH_AND = {"and": [{"range": "year", "from": 1996, "to": 1998}, {"term": "genre", "values": ["R1", "R3"], "children": True}, {"not": {"term": "lang", "values": ["5-LOW"]}}]}
_AND_SQL = """, m as (select * from seen where year between 1996 and 1998 and lang <> '5-LOW'
  and book_id in (select book_id from genre_links join genres using (genre_code) where parent_code in ('R1', 'R3') or genre_code in ('R1', 'R3')))"""
_PAGE = "book_id, title, year, size, sort_key"


@query(_AND_SQL + " select book_id, title, year, size, search_title as sort_key from m order by search_title, book_id limit 50")
def search_and(spark, d):
    cat = cat_of(spark, d)
    return pg.page(pg.with_sort_key(cat, match(cat, SEARCH_AND), "title")).select(*_PAGE.split(", "))


@query(""" select book_id, title from seen where book_id in (select book_id from author_links where author_id in (1, 5, 9))
  or year = 1997 and not (book_id in (select book_id from series_links where series_id = 3)) or ext = '.o' and lib_rate = 1""")
def search_or(spark, d):
    tree = {"or": [{"ids": "author", "values": [1, 5, 9]}, {"and": [{"number": "year", "op": "eq", "value": 1997}, {"not": {"ids": "series", "values": [3]}}]}, {"and": [{"term": "ext", "values": ["o"]}, {"number": "lib_rate", "op": "eq", "value": 1}]}]}
    return match(cat_of(spark, d), tree).select("book_id", "title")


@query(""", n as (select *, case when lib_rate > 2 then year end as y from seen) select book_id, y as year from n where not coalesce(y = 1997, false)""")
def search_not_null(spark, d):
    cat = cat_of(spark, d)
    cat.books = cat.books.withColumn("year", F.when(F.col("lib_rate") > 2, F.col("year")))  # years that are unknown
    return match(cat, {"not": {"number": "year", "op": "eq", "value": 1997}}).select("book_id", "year")


@query(""" select book_id, year, size from seen where year >= 1999 and size <= 200000 and lib_rate > 1
  and book_id in (select book_id from user_data where user_id = 1 and rate between 2 and 5)""")
def search_range(spark, d):
    tree = {"and": [{"range": "year", "from": 1999}, {"range": "size", "to": 200000}, {"number": "lib_rate", "op": "gt", "value": 1}, {"range": "user_rate", "from": 2, "to": 5}]}
    return match(cat_of(spark, d), tree).select("book_id", "year", "size")


@query(""" select book_id from seen where book_id in (select book_id from series_links where seq >= 5)
  and book_id in (select book_id from keyword_links where keyword_id in ('ECONOMY', 'STANDARD')) and archive in ('BUILDING', 'MACHINERY')""")
def search_link_any(spark, d):
    tree = {"and": [{"number": "seq", "op": "gte", "value": 5}, {"ids": "keyword", "values": ["ECONOMY", "STANDARD"]}, {"term": "archive", "values": ["BUILDING", "MACHINERY"]}]}
    return match(cat_of(spark, d), tree).select("book_id")


_GROUPS = """, g as (select n_regionkey::bigint as group_id, n_nationkey::varchar as object_id from nation union all select distinct length(p_type)::bigint % 5, p_type from part), gm as (
  select group_id, book_id from g join books on book_id::varchar = object_id union select group_id, book_id from g join author_links on author_id::varchar = object_id
  union select group_id, book_id from g join series_links on series_id::varchar = object_id union select group_id, book_id from g join keyword_links on keyword_id = object_id)"""


@query(_GROUPS + " select group_id, book_id from gm")
def group_books(spark, d):
    return group_members(cat_of(spark, d))


@query(_GROUPS + " select book_id from seen where book_id in (select book_id from gm where group_id = 2)")
def search_group_members(spark, d):
    return match(cat_of(spark, d), {"ids": "group", "values": [2]}).select("book_id")


@query(""" select book_id from seen where book_id not in (select book_id from user_data where user_id = 1 and favorite = 1)
  and book_id in (select l_orderkey from lineitem where l_returnflag = 'R') and book_id not in (select l_orderkey from lineitem group by 1 having count(*) > 3)""")
def search_bool_false(spark, d):
    tree = {"and": [{"flag": "favorite", "value": False}, {"flag": "has_review", "value": True}, {"flag": "has_annotation", "value": False}]}
    return match(cat_of(spark, d), tree).select("book_id")


@query(" select book_id, deleted from books where deleted or year = 2000")
def visibility(spark, d):
    return match(cat_of(spark, d), {"or": [{"flag": "deleted", "value": True}, {"number": "year", "op": "eq", "value": 2000}]}).select("book_id", "deleted")


@query(_AND_SQL + """, k as (select book_id, arg_min(upper(last_name), {'a': ord, 'b': author_id}) as k from author_links join authors using (author_id) group by 1)
  select m.book_id, title, year, size, coalesce(k, '') as sort_key from m left join k using (book_id) order by sort_key desc, book_id desc limit 50""")
def sort_first_author(spark, d):
    cat = cat_of(spark, d)
    return pg.page(pg.with_sort_key(cat, match(cat, SEARCH_AND), "author"), descending=True).select(*_PAGE.split(", "))


@query(" select book_id, title, year, size, size as sort_key from seen where size > 250000 or size = 250000 and book_id > 100 order by size, book_id limit 100")
def page_keyset(spark, d):
    cat = cat_of(spark, d)
    return pg.page(pg.with_sort_key(cat, match(cat, None), "size"), limit=100, after=(250000, 100)).select(*_PAGE.split(", "))


@query(" select book_id, title, year, size, year as sort_key from seen order by year desc, book_id desc limit 50 offset 120")
def page_offset(spark, d):
    cat = cat_of(spark, d)
    return pg.page(pg.with_sort_key(cat, match(cat, None), "year"), offset=120, descending=True).select(*_PAGE.split(", "))


@query(" select book_id, title, year, size, size as sort_key from seen order by size desc, book_id desc limit 100 offset least(5000000, (select count(*) * 3 // 4 from seen))")
def page_deep(spark, d):
    """A page behind three quarters of all books."""
    matched = match(cat_of(spark, d), None)
    return pg.page(pg.with_sort_key(cat_of(spark, d), matched, "size"), limit=100, descending=True, offset=matched.count() * 3 // 4).select(*_PAGE.split(", "))


@query(_AND_SQL + """, p as (select *, row_number() over (order by search_title, book_id) as place from m)
 select book_id, title, search_title as sort_key, (select search_title from p where place = 60) as next_key, (select book_id from p where place = 60) as next_id from p where place between 31 and 60""")
def page_following(spark, d):
    """The page behind the one that a first response's next key ends, with its own next key."""
    cat = cat_of(spark, d)
    matched = match(cat, SEARCH_AND)
    first = pg.page_response(cat, matched, "title", with_next=True, limit=30).select("next_key", "next_id").first()
    return pg.page_response(cat, matched, "title", with_next=True, limit=30, after=tuple(first)).select("book_id", "title", "sort_key", "next_key", "next_id")


@query(" select book_id from seen where book_id in (select book_id from genre_links where genre_code in ('N3', 'N7', 'R1'))")
def search_genre_exact(spark, d):
    return match(cat_of(spark, d), {"term": "genre", "values": ["N3", "N7", "R1"]}).select("book_id")


@query(""" select book_id from seen where book_id in (select book_id from user_data where user_id = 3 and read = 1) and book_id in (select book_id from series_links where seq between 2 and 3)
  and lib_rate between 2 and 4""")
def search_read(spark, d):
    return match(cat_of(spark, d), {"and": [{"flag": "read", "value": True}, {"range": "seq", "from": 2, "to": 3}, {"range": "lib_rate", "from": 2, "to": 4}]}, user=3).select("book_id")


@query(""" select book_id from seen where (book_id in (select book_id from user_data where user_id = 3 and rate > 3) or book_id not in (select book_id from user_data where user_id = 3 and read = 1) and year < 1995
  or book_id in (select book_id from user_data where user_id = 3 and favorite = 1)) and not (book_id in (select book_id from author_links where author_id = 7) or book_id in (select book_id from author_links where author_id < 5))""")
def search_flags(spark, d):
    """Several leaves over one link table, inside OR and NOT: one aggregate for each table."""
    any_of = {"or": [{"number": "user_rate", "op": "gt", "value": 3}, {"and": [{"flag": "read", "value": False}, {"number": "year", "op": "lt", "value": 1995}]}, {"flag": "favorite", "value": True}]}
    tree = {"and": [any_of, {"not": {"or": [{"ids": "author", "values": [7]}, {"ids": "author", "values": [0, 1, 2, 3, 4]}]}}]}
    return match(cat_of(spark, d), tree, user=3).select("book_id")


@query(" select book_id, deleted, file_name from books where deleted <> (book_id in (select o_orderkey from orders where o_orderstatus = 'P')) or book_id < 50")
def effective_books(spark, d):
    """The effective view where a user's override changed the flag, and the first books."""
    cat = cat_of(spark, d)
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), (F.col("o_orderstatus") == "P").alias("own"))
    return cat.books.join(own, "book_id").filter("deleted <> own or book_id < 50").select("book_id", "deleted", "file_name")


_SORTS = {
    "lib_rate": "coalesce(lib_rate, 0)", "added_at": "coalesce(update_id, 0)", "user_rate": "coalesce((select max(rate) from user_data u where u.book_id = s.book_id and user_id = 2), 0)",
    "seq": "coalesce((select min(seq) from series_links l where l.book_id = s.book_id), 0)",
    "series": "coalesce((select arg_min(upper(s_name), {'a': ord, 'b': series_id}) from series_links l join supplier on s_suppkey = series_id where l.book_id = s.book_id), '')",
}


def _sort_query(key: str, expression: str) -> None:
    def run(spark, d):
        cat = cat_of(spark, d)
        return pg.page(pg.with_sort_key(cat, match(cat, None), key, user=2), limit=200, descending=key == "series").select("book_id", F.col("sort_key"))

    run.__name__ = f"sort_{key}"
    way = " desc" if key == "series" else ""
    query(f" select book_id, {expression} as sort_key from seen s order by sort_key{way}, book_id{way} limit 200")(run)


for _k, _e in _SORTS.items():
    _sort_query(_k, _e)


_RELATIONS = """, ra as (select book_id, string_agg(page_name, '; ' order by ord) as authors from author_links join authors using (author_id) group by 1),
 rg as (select book_id, string_agg(title, '; ') as genres from genre_links join genres using (genre_code) group by 1),
 rk as (select book_id, string_agg(keyword_id, '; ' order by ord) as keywords from keyword_links group by 1),
 rs as (select book_id, series_id, seq, s_name as series_title from series_links join supplier on s_suppkey = series_id where ord = 0)"""


@query(_AND_SQL + _RELATIONS + """, p as (select *, search_title as sort_key from m order by search_title, book_id limit 50)
 select p.book_id, title, year, lang, substr(ext, 2) as ext, size, lib_rate, series_id, series_title, seq as seq_number, sort_key, coalesce(rate, 0) as user_rate,
   coalesce(favorite = 1, false) as favorite, coalesce(read = 1, false) as is_read, authors, genres, keywords
 from p left join rs using (book_id) left join ra using (book_id) left join rg using (book_id) left join rk using (book_id) left join user_data u on u.book_id = p.book_id and user_id = 1""")
def page_relations(spark, d):
    cat = cat_of(spark, d)
    return flat(pg.page_response(cat, match(cat, SEARCH_AND), "title"))


@query(_AND_SQL + _RELATIONS + """, p as (select *, year as sort_key from m order by year desc, book_id desc limit 20 offset 30)
 select p.book_id, title, sort_key, authors, genres, keywords, (select count(*) from m) as total from p left join ra using (book_id) left join rg using (book_id) left join rk using (book_id)""")
def search_response(spark, d):
    cat = cat_of(spark, d)
    found = pg.page_response(cat, match(cat, SEARCH_AND), "year", with_total=True, limit=20, offset=30, descending=True)
    return flat(found).select("book_id", "title", "sort_key", "authors", "genres", "keywords", "total")


@query(_AND_SQL + " select count(*) as total from m")
def total(spark, d):
    return pg.total(match(cat_of(spark, d), SEARCH_AND))


FACET_TREE = {"and": [{"term": "lang", "values": ["1-URGENT", "2-HIGH"]}, {"ids": "author", "values": [1, 2, 3, 4, 5, 6, 7, 8]}, {"range": "year", "from": 1996, "to": 1999}]}
_FACET_C = """, c as (select *, lang in ('1-URGENT', '2-HIGH') as c1, book_id in (select book_id from author_links where author_id between 1 and 8) as c2, year between 1996 and 1999 as c3 from seen)"""
_FACET_V = {
    "lang": ("select 'lang' as field, lang as value, null as label from c where c2 and c3", "(lang in ('1-URGENT', '2-HIGH'))"),
    "ext": ("select 'ext' as field, ltrim(ext, '.') as value, null as label from c where c1 and c2 and c3", ""),
    "year": ("select 'year' as field, year::varchar as value, null as label from c where c1 and c2 and year > 0", ""),
    "lib_rate": ("select 'lib_rate' as field, lib_rate::varchar as value, null as label from c where c1 and c2 and c3 and lib_rate > 0", ""),
    "genre": ("select 'genre' as field, genre_code as value, genres.title as label from c join genre_links using (book_id) left join genres using (genre_code) where c1 and c2 and c3", ""),
    "author": ("select 'author' as field, author_id::varchar as value, facet_name as label from c join author_links using (book_id) join authors using (author_id) where c1 and c3", ""),
    "series": ("select 'series' as field, series_id::varchar as value, s_name as label from c join series_links using (book_id) join supplier on s_suppkey = series_id where c1 and c2 and c3", ""),
}


def _facet_sql(fields: list[str]) -> str:
    return (
        _FACET_C + ", v as (" + " union all ".join(_FACET_V[f][0] for f in fields) + """),
 n as (select field, value, label, count(*) as n, case when field = 'lang' and value in ('1-URGENT', '2-HIGH') or field = 'author' and value in ('1', '2', '3', '4', '5', '6', '7', '8') then 0 else 1 end as pin,
   case when field in ('year', 'lib_rate') then 200 else 20 end as most from v group by field, value, label),
 r as (select *, row_number() over (partition by field order by pin, n desc, coalesce(label, value), value) as rank, count(*) over (partition by field) > most as truncated from n),
 a as (select field, value, label, n, pin, truncated from r where rank <= most
   union all select f, x, label, 0, -1, coalesce((select any_value(truncated) from r where field = f), false) from (
     select 'lang' as f, unnest(['1-URGENT', '2-HIGH']) as x, null as label union all select 'author', author_id::varchar, facet_name from authors where author_id between 1 and 8) z
   where (f, x) not in (select (field, value) from r where rank <= most) and f in (""" + ", ".join(f"'{f}'" for f in fields) + """))
 select field, value, case when label <> value then label end as label, n, truncated,
   row_number() over (partition by field order by case when field in ('year', 'lib_rate') then -value::bigint end, pin, n desc, coalesce(label, value), value) as place from a"""
    )


def _facet_query(name: str, fields: list[str]) -> None:
    def run(spark, d):
        return fc.facets(cat_of(spark, d), FACET_TREE, fields)

    run.__name__ = name
    query(_facet_sql(fields))(run)


for _f in fc.FIELDS:
    _facet_query(f"facet_{_f}", [_f])
_facet_query("facets_one_pass", list(fc.FIELDS))
_facet_query("facet_pinned_zero", ["lang", "author"])


def bitmaps_of(spark: SparkSession, d: str, cat: Catalog) -> DataFrame:
    return bm.bitmap_index(spark, cat, input_files(d, *CATALOG_TABLES))


@query(_facet_sql(list(fc.FIELDS)))
def facets_bitmap(spark, d):
    """facets_one_pass from the bitmaps of values."""
    cat = cat_of(spark, d)
    return bm.facets(cat, bitmaps_of(spark, d, cat), FACET_TREE, list(fc.FIELDS))


#: Leaves that the bitmaps answer (a category with those below it, an author) and others (a size, a user's mark), in OR and NOT.
BITMAP_TREE = {"or": [{"and": [{"term": "genre", "values": ["R1"], "children": True}, {"not": {"ids": "author", "values": [1, 2, 3]}}]}, {"and": [{"number": "size", "op": "gte", "value": 200000}, {"flag": "read", "value": False}]}]}
_BITMAP_C = """, c as (select * from seen where
  book_id in (select book_id from genre_links join nation on genre_code = 'N' || n_nationkey where n_regionkey = 1) and book_id not in (select book_id from author_links where author_id in (1, 2, 3))
  or size >= 200000 and book_id not in (select book_id from user_data where user_id = 1 and read = 1))"""


@query(_BITMAP_C + " select count(*) as total from c")
def total_bitmap(spark, d):
    cat = cat_of(spark, d)
    return bm.total(cat, bitmaps_of(spark, d, cat), BITMAP_TREE)


@query(_BITMAP_C + """, v as (select 'ext' as field, ltrim(ext, '.') as value, null as label from c union all select 'genre', genre_code, genres.title from c join genre_links using (book_id) left join genres using (genre_code)),
 n as (select field, value, label, count(*) as n from v group by all), r as (select *, row_number() over (partition by field order by n desc, coalesce(label, value), value) as place, count(*) over (partition by field) > 20 as truncated from n)
 select field, value, case when label <> value then label end as label, n, truncated, place from r where place <= 20""")
def facets_bitmap_tree(spark, d):
    """Bits of a tree with OR and NOT."""
    cat = cat_of(spark, d)
    return bm.facets(cat, bitmaps_of(spark, d, cat), BITMAP_TREE, ["ext", "genre"])


@query(""", c as (select * from seen where (lang = '1-URGENT' or year = 1997)) select 'lang' as field, lang as value, null::varchar as label, count(*) as n,
  row_number() over (order by count(*) desc, lang) as place, false as truncated from c group by lang""")
def facet_self_exclude(spark, d):
    tree = {"or": [{"term": "lang", "values": ["1-URGENT"]}, {"number": "year", "op": "eq", "value": 1997}]}  # inside OR a facet keeps its own predicate
    return fc.facets(cat_of(spark, d), tree, ["lang"])


@query(""", c as (select * from seen where year = 1997), v as (select lang as value, null as label, count(*) as n from c group by 1)
 select 'lang' as field, value, label, n, false as truncated, 2 + row_number() over (order by case when value = '1-URGENT' then 0 else 1 end, n desc, value) - 1 as place from v
 union all select 'lang', 'NO-SUCH', null, 0, false, 1""")
def facet_zero_rows(spark, d):
    """A selected value without any book comes first, with the count 0."""
    tree = {"and": [{"term": "lang", "values": ["1-URGENT", "NO-SUCH"]}, {"number": "year", "op": "eq", "value": 1997}]}
    return fc.facets(cat_of(spark, d), tree, ["lang"])


@query(""", v as (select author_id::varchar as value, facet_name as label, count(*) as n from seen join author_links using (book_id) join authors using (author_id) where year = 1996 and author_id % 3 = 0 group by all),
 g as (select genre_code as value, case when genre_code < 'N2' then genres.title end as label, count(*) as n from seen join genre_links using (book_id) join genres using (genre_code) where year = 1996 group by all),
 r as (select 'author' as field, *, row_number() over (order by n desc, coalesce(label, value), value) as place, count(*) over () > 20 as truncated from v
   union all select 'genre', *, row_number() over (order by n desc, coalesce(label, value), value), count(*) over () > 20 from g)
 select field, value, case when label <> value then label end as label, n, truncated, place from r where place <= 20""")
def facet_dangling(spark, d):
    """Links without a dictionary row: authors vanish, categories stay without a label."""
    cat = cat_of(spark, d)
    cat.authors, cat.genres = cat.authors.filter("author_id % 3 = 0"), cat.genres.filter("genre_code < 'N2'")
    return fc.facets(cat, {"number": "year", "op": "eq", "value": 1996}, ["author", "genre"])


@query(""", c as (select * from seen where lang in ('1-URGENT', '2-HIGH') and year between 1996 and 1999), x as (select * from seen where year between 1996 and 1999),
 e as (select ltrim(ext, '.') as value, count(*) as n from c group by 1), l as (select lang as value, count(*) as n from x group by 1)
 select 0 as facet_no, 'total' as field, null::varchar as value, null::varchar as label, (select count(*) from c) as n, 1 as place, false as truncated
 union all select 1, 'ext', value, null, n, row_number() over (order by n desc, value), false from e
 union all select 2, 'lang', value, null, n, row_number() over (order by case when value in ('1-URGENT', '2-HIGH') then 0 else 1 end, n desc, value), false from l""")
def facet_response(spark, d):
    tree = {"and": [{"term": "lang", "values": ["1-URGENT", "2-HIGH"]}, {"range": "year", "from": 1996, "to": 1999}]}
    return fc.facet_response(cat_of(spark, d), tree, ["ext", "lang"])


@query(" select genre_code as root, genre_code as code, 0 as depth from genres union all select parent_code, genre_code, 1 from genres where parent_code <> ''")
def genre_closure(spark, d):
    return hi.closure(cat_of(spark, d).genres)


@query(""" select g.genre_code as code, (g.parent_code <> '')::int as depth, g.parent_code = '' as is_root, coalesce(p.title || ' / ', '') || g.title as path
  from genres g left join genres p on p.genre_code = g.parent_code""")
def genre_paths(spark, d):
    return hi.tree_paths(cat_of(spark, d).genres)


@query(""", cl as (select genre_code as root, genre_code as code from genres where not deleted union all select parent_code, genre_code from genres where parent_code <> '' and not deleted),
 k as (select root, count(distinct book_id) as books, count(distinct case when root = code then book_id end) as own from cl join genre_links on genre_code = code join seen using (book_id) group by 1)
 select genre_code as code, nullif(parent_code, '') as parent_code, title, coalesce(books, 0) as books, coalesce(own, 0) as own_books from genres left join k on root = genre_code where not deleted""")
def genre_subtree_counts(spark, d):
    return hi.subtree_counts(cat_of(spark, d))


@query(""", s as (select book_id, genre_code as code from genre_links union select book_id, parent_code from genre_links join genres using (genre_code) where year_odd(book_id))
 select book_id, code from s where not exists (select 1 from s t join genres g on g.genre_code = s.code where t.book_id = s.book_id and t.code = g.parent_code)""".replace("year_odd(book_id)", "book_id % 2 = 1"))
def selection_collapse(spark, d):
    cat = cat_of(spark, d)
    own = cat.genre_links.select("book_id", F.col("genre_code").alias("code"))
    up = cat.genre_links.join(cat.genres, "genre_code").filter("book_id % 2 = 1").select("book_id", F.col("parent_code").alias("code"))  # odd books also select the parent
    return hi.topmost(own.unionByName(up), cat.genres)


@query(""" select (select count(*) from seen) as books, (select count(distinct lang) from books) as languages, (select min(year) from seen where year between 1400 and 2200) as year_from,
 (select max(year) from seen where year between 1400 and 2200) as year_to, (select count(*) from part) as authors, (select count(*) from supplier) as series,
 (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 3)) as annotations""")
def collection_summary(spark, d):
    return rp.collection_summary(cat_of(spark, d))


@query(""" select (select count(*) from seen) as books, (select count(*) from part) as authors, (select count(*) from books) as indexed_books, (select max(update_id) from books) as index_mark, true as dated""")
def summary_indexed(spark, d):
    """The summary with what the index's state says: its books, mark and time."""
    cat, index = catalog_index(spark, d)
    found = rp.collection_summary(cat, index.state)
    return found.select("books", "authors", "indexed_books", "index_mark", F.to_timestamp("indexed_at").isNotNull().alias("dated"))


@query(""", found as (select * from authors where (contains(upper(last_name), 'RE') or len(list_filter(regexp_split_to_array(upper(list_name), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'RE'))) > 0)
   and author_id in (select author_id from author_links))
 select author_id, list_name as name, coalesce(b.n, 0) as books, (select count(*) from found) as total from found
 left join (select author_id, count(*) as n from author_links join seen using (book_id) group by 1) b using (author_id)
 order by case when starts_with(upper(last_name), 'RE') then 0 else 1 end, upper(last_name), author_id limit 100""")
def author_list(spark, d):
    return rp.author_list(cat_of(spark, d), "re", limit=100)


@query(" select lang, count(*) as books from seen where lang is not null group by 1")
def languages(spark, d):
    return rp.languages(cat_of(spark, d))


_PREFIX = "(select left(upper(max(last_name)), 1) from authors)"


@query(f" select author_id as id, list_name as label, count(distinct book_id) as books from authors join author_links using (author_id) join seen using (book_id) where starts_with(upper(list_name), {_PREFIX}) group by 1, 2 order by books desc, id limit 10")
def suggest_author(spark, d):
    """By the first letter of the last surname, so that there are authors to suggest."""
    cat = cat_of(spark, d)
    return rp.suggest(cat, "author", cat.authors.agg(F.left(F.max("last_name"), F.lit(1))).first()[0].lower())


@query(" select series_id as id, s_name as label, count(distinct book_id) as books from series_links join supplier on s_suppkey = series_id join seen using (book_id) where starts_with(upper(s_name), 'SUPPLIER#00000000') group by 1, 2 order by books desc, id limit 10")
def suggest_series(spark, d):
    return rp.suggest(cat_of(spark, d), "series", "supplier#00000000")


@query(" select keyword_id as id, keyword_id as label, count(distinct book_id) as books from keyword_links join seen using (book_id) where starts_with(upper(keyword_id), 'S') group by 1 order by books desc, id limit 10")
def suggest_keyword(spark, d):
    return rp.suggest(cat_of(spark, d), "keyword", "s")


@query(" select book_id, title from seen where starts_with(search_title, '3-M') order by search_title, book_id limit 10")
def suggest_title(spark, d):
    return rp.suggest(cat_of(spark, d), "title", "3-m")


@query(_RELATIONS + """, an as (select l_orderkey as book_id, 'a book of ' || count(*) || ' lines' as annotation from lineitem group by 1 having count(*) > 3)
 select book_id, title, year, lang, size, archive, substr(ext, 2) || '+zip' as formats, file_name, annotation, series_title, seq as seq_number, authors, genres, keywords
 from seen left join rs using (book_id) left join an using (book_id) left join ra using (book_id) left join rg using (book_id) left join rk using (book_id)""")
def book_card(spark, d):
    return flat(rp.book_cards(cat_of(spark, d)))


@query(""" select series_id, book_id, seq, lag(book_id) over (partition by series_id order by seq, book_id) as previous,
  lead(book_id) over (partition by series_id order by seq, book_id) as following from series_links join seen using (book_id)""")
def series_neighbours(spark, d):
    return rp.series_neighbours(cat_of(spark, d))


@query(f"select doc_id, len({tok('text')})::bigint as n_tokens, len(list_distinct({tok('text')}))::bigint as n_forms from documents", base=False)
def tokens_forms(spark, d):
    own = tokens(F.col("text"), fold=True)
    return table(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.size(F.array_distinct(own)).cast("long").alias("n_forms"))


@query(f"with {POSTS} select field, term, book_id from posts", base=False)
def index_postings(spark, d):
    return ix.postings(documents_source(spark, d), FIELDS)


@query(f"with {POSTS} select field, term, count(*) as books from posts group by all", base=False)
def index_terms(spark, d):
    """The vocabulary of the written index."""
    return documents_index(spark, d).vocabulary()


@query(f"with {POSTS} select book_id, count(*) as dl from posts group by all", base=False)
def index_sizes(spark, d):
    return documents_index(spark, d).sizes


@query(f"""with {POSTS}, t as (select book_id, list_aggregate({tok("title")}, 'string_agg', ' ') as t from src) select distinct 'title' as field, t[i:i + 2] as gram, book_id
 from (select book_id, t, unnest(generate_series(1, len(t) - 2)) as i from t where len(t) >= 3)""", base=False)
def index_grams(spark, d):
    return ix.grams(documents_source(spark, d), GRAM_FIELDS)


@query(f"with {POSTS} select book_id from posts where term in ('erth', 'thnt') group by book_id having count(distinct term) = 2", base=False)
def text_match(spark, d):
    return st.match(documents_index(spark, d), "erth thnt")


@query(f"with {POSTS} select book_id from posts where field = 'title' and term in ('the', 'of') group by book_id having count(distinct term) = 2", base=False)
def text_match_field(spark, d):
    return st.match(documents_index(spark, d), "The, of", "title")


@query(f"with {POSTS} select book_id from posts where field = 'title' and starts_with(term, 'therr') group by book_id", base=False)
def text_prefix(spark, d):
    return st.match(documents_index(spark, d), "therr", "title", "prefix")


@query(f"with {POSTS} select book_id from posts where starts_with(term, 'therr') or starts_with(term, 'thn') group by book_id having bool_or(starts_with(term, 'therr')) and bool_or(starts_with(term, 'thn'))", base=False)
def text_prefix_words(spark, d):
    return st.match(documents_index(spark, d), "therr Thn", op="prefix")


_OF_THE = "len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'of' and w[i + 1] = 'the'))"


@query(f"with {POSTS}, w as (select book_id, {tok('annotation')} as w from src) select book_id, annotation from (select book_id, {_OF_THE} as annotation from w) where annotation > 0", base=False)
def text_phrase(spark, d):
    return st.phrase(documents_index(spark, d), ["annotation"], "of the").withColumn("annotation", F.col("annotation").cast("long"))


@query(f"with {POSTS} select book_id from src where contains(list_aggregate({tok('title')}, 'string_agg', ' '), 'ing th')", base=False)
def text_substring(spark, d):
    return st.substring(documents_index(spark, d), "title", "Íng,th")


@query(f"with {POSTS} select book_id from src where list_has_all({tok('title')}, ['the', 'of']) or list_has_all({tok('annotation')}, ['the', 'of'])", base=False)
def text_fallback(spark, d):
    return st.unindexed(documents_source(spark, d), ["title", "annotation"], "the; of,")


@query(f"with {POSTS}, p as (select book_id, ' ' || list_aggregate({tok('annotation')}, 'string_agg', ' ') || ' ' as t from src) select book_id from p where contains(t, ' of the ')", base=False)
def text_fallback_phrase(spark, d):
    return st.unindexed(documents_source(spark, d), ["annotation"], "of  The", "phrase")


@query(f"with {POSTS} select book_id from src where len(list_filter({tok('annotation')}, lambda x: starts_with(x, 'therr'))) > 0 and len(list_filter({tok('annotation')}, lambda x: starts_with(x, 'thn'))) > 0", base=False)
def text_fallback_prefix(spark, d):
    return st.unindexed(documents_source(spark, d), ["annotation"], "therr thn", "prefix")


_NAME = "lower(list_name)"


@query(f""" select distinct book_id from author_links join authors using (author_id) where list_contains(string_split({_NAME}, ' '), 'ring') and len(list_filter(regexp_split_to_array({_NAME}, '[^a-z0-9]+'), lambda x: x = 'small')) > 0""")
def text_fallback_author(spark, d):
    return st.unindexed_catalog(cat_of(spark, d), "author", "Small ring")


@query(""" select distinct book_id from series_links join supplier on s_suppkey = series_id where contains(upper(s_name), 'R#00000000')""")
def text_fallback_series(spark, d):
    return st.unindexed_catalog(cat_of(spark, d), "series", "r#00000000", "substring")


@query(" select distinct book_id from keyword_links where starts_with(upper(keyword_id), 'ECO')")
def text_fallback_keyword(spark, d):
    return st.unindexed_catalog(cat_of(spark, d), "keyword", "eco")


@query(f""" select book_id from author_links join authors using (author_id) where len(list_filter(regexp_split_to_array({_NAME}, '[^a-z0-9]+'), lambda x: x = 'red')) > 0
  union select book_id from series_links join supplier on s_suppkey = series_id where list_contains(regexp_split_to_array(lower(s_name), '[^a-z0-9]+'), 'red')
  union select book_id from books where list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), 'red')""")
def text_fallback_any(spark, d):
    return st.unindexed_catalog(cat_of(spark, d), "any", "red")


@query(f"""with {POSTS}, w as (select item_id as query_id, list_distinct({tok("text")}) as ws from benchmark), q as (select query_id, unnest(ws) as term, len(ws) as words from w)
 select query_id, book_id from q join (select distinct term, book_id from posts) p using (term) group by query_id, book_id, words having count(*) = words""", base=False)
def batch_search(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return st.search(asked, documents_index(spark, d))


@query(f"""with {POSTS}, k as (select distinct p_partkey as query_id, substr(string_split(p_name, ' ')[1], 1, 2) as pre from part where p_partkey < 1000000000 and p_size = 11)
 select distinct query_id, book_id from k join posts on starts_with(term, pre) and field = 'title'""", base=False)
def batch_prefix(spark, d):
    asked = table(spark, d, "part").filter("p_size = 11").select(F.col("p_partkey").alias("query_id"), F.substring(F.split("p_name", " ")[0], 1, 2).alias("text"))
    return st.search(asked, documents_index(spark, d), "title", prefix=True)


_GAIN = """dl as (select book_id, count(*) as dl from posts group by 1), corpus as (select count(*) as n_books, avg(dl) as avgdl from dl),
 f as materialized ({f}), h as (select term, count(*) as n from f group by 1),
 g as (select book_id, sum(greatest(ln((n_books - n + 0.5::double) / (n + 0.5::double)), 1e-6::double) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as score, count(*) as words from f join h using (term) join dl using (book_id), corpus group by 1)"""
_BM25 = _GAIN + " select book_id, round(score, 6) as score from g where words = {words} order by round(score, 6) desc, book_id limit 20"
_FORMS_F = "select term, book_id, sum(case field when 'title' then 10 else 1 end) as f from posts where term in ('erth', 'thnt') group by all"
_PREFIX_F = "select 0 as term, book_id, sum(case field when 'title' then 10 else 1 end) as f from posts where starts_with(term, 'therr') group by all"
_PHRASE_F = f"select 0 as term, book_id, f from (select book_id, {_OF_THE} as f from (select book_id, {tok('annotation')} as w from src)) where f > 0"


def _best(scored: DataFrame) -> DataFrame:
    return scored.select("book_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "book_id").limit(20)


@query(f"with {POSTS}, {_BM25.format(f=_FORMS_F, words=2)}", base=False)
def bm25_top(spark, d):
    return _best(st.bm25(documents_index(spark, d), "erth thnt"))


@query(f"""with {POSTS}, asked as materialized (select unnest(list_distinct({tok("text")})) as term from documents where doc_id = (select min(doc_id) from documents where len(list_distinct({tok("text")})) >= 100)),
 {_GAIN.format(f="select term, book_id, sum(case field when 'title' then 10 else 1 end) as f from posts where term in (select term from asked) group by all")}
 select book_id, round(score, 6) as score from g where words = (select count(*) from asked) order by round(score, 6) desc, book_id limit 20""", base=False)
def bm25_long(spark, d):
    """All words of the first document of 100 different ones or more, as one query."""
    words = F.array_distinct(tokens(F.col("text"), fold=True))
    text = " ".join(table(spark, d, "documents").select("doc_id", words.alias("w")).filter(F.size("w") >= 100).orderBy("doc_id").first().w)  # one text
    return _best(st.bm25(documents_index(spark, d), text))


@query(f"with {POSTS}, {_BM25.format(f=_PREFIX_F, words=1)}", base=False)
def bm25_prefix(spark, d):
    return _best(st.bm25(documents_index(spark, d), "therr", op="prefix"))


@query(f"with {POSTS}, {_BM25.format(f=_PHRASE_F, words=1)}", base=False)
def bm25_phrase(spark, d):
    return _best(st.bm25(documents_index(spark, d), "of the", "annotation", "phrase"))


_THE_F = "select 0 as term, book_id, 10 * count(*) as f from posts where field = 'title' and starts_with(term, 'the') group by all"


@query(f"with {POSTS}, {_GAIN.format(f=_THE_F)} select book_id, title from g join src using (book_id) order by round(score, 6) desc, book_id limit 10", base=False)
def suggest_title_indexed(spark, d):
    return rp.suggest_title(documents_index(spark, d), documents_source(spark, d), "the")


# Queries over the whole text as a field that may hold grams, or as the only field.


@query(f"with {WHOLE} select field, term, book_id from posts", base=False)
def index_postings_whole(spark, d):
    return ix.postings(whole_source(spark, d), ["title", "annotation"])


@query(f"""with {WHOLE}, t as (select book_id, list_aggregate({tok("body")}, 'string_agg', ' ') as t from src) select distinct 'body' as field, t[i:i + 2] as gram, book_id
 from (select book_id, t, unnest(generate_series(1, len(t) - 2)) as i from t where len(t) >= 3)""", base=False)
def index_grams_whole(spark, d):
    return ix.grams(whole_source(spark, d), ["body"])


@query(f"with {WHOLE} select book_id from posts where field = 'annotation' and starts_with(term, 'therr') group by book_id", base=False)
def text_prefix_whole(spark, d):
    return st.match(documents_index(spark, d), "therr", "annotation", "prefix")


@query(f"with {WHOLE} select book_id from src where contains(list_aggregate({tok('body')}, 'string_agg', ' '), 'ing th')", base=False)
def text_substring_whole(spark, d):
    return st.substring(body_index(spark, d), "body", "ing th")


@query(f"""with {WHOLE}, w as (select item_id as query_id, list_distinct({tok("text")}) as ws from benchmark), q as (select query_id, unnest(ws) as term, len(ws) as words from w)
 select query_id, book_id from q join (select distinct term, book_id from posts) p using (term) group by query_id, book_id, words having count(*) = words""", base=False)
def batch_search_whole(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return st.search(asked, documents_index(spark, d), "annotation")


@query(f"with {WHOLE}, {_BM25.format(f=_FORMS_F, words=2)}", base=False)
def bm25_top_whole(spark, d):
    return _best(st.bm25(documents_index(spark, d), "erth thnt"))


MARK = 12 * 2000 + 6


def catalog_index(spark: SparkSession, d: str) -> tuple[Catalog, ix.TextIndex]:
    """The catalog, and its index brought up to date."""
    cat, root = cat_of(spark, d), index_root(spark, d, "catalog-index", list(ix.WEIGHTS), CATALOG_GRAMS)
    catalog_build(spark, cat, root, cat.books, files=input_files(d, *CATALOG_TABLES))
    return cat, ix.read_index(spark, root)


@query(f""", o as (select count(*) as n from books where update_id <= {MARK}), c as (select count(*) as books, max(update_id) as mark from books)
 select case when books = n then 'skipped' when mark > {MARK} then 'incremental' else 'full' end as action, case when mark > {MARK} then {MARK}::bigint end as since, books, mark from c, o""")
def index_decision(spark, d):
    books = cat_of(spark, d).books
    held = books.filter(F.col("update_id") <= MARK).count()
    return ix.decide(books, {"mark": MARK, "books": held})


@query(""", c as (select count(*) as books, max(update_id) as mark from books)
 select 'first' as state, 'full' as action, books, mark from c union all select 'same', 'skipped', books, mark from c union all select 'fewer below the mark', 'full', books, mark from c""")
def index_decisions(spark, d):
    """The other branches of the decision: no state, nothing new, and books missing below the mark."""
    books = cat_of(spark, d).books
    now = ix.fingerprint(books).first()
    states = {"first": None, "same": {"mark": now.mark, "books": now.books}, "fewer below the mark": {"mark": now.mark - 1, "books": now.books}}
    each = [ix.decide(books, state).select(F.lit(name).alias("state"), "action", "books", "mark") for name, state in states.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(" select count(*) as books, max(update_id) as mark, 1::bigint as files, (select count(*) from orders) > 0 as any_file, true as sized from books")
def index_fingerprint(spark, d):
    cat, manifest = cat_of(spark, d), file_manifest(spark, input_files(d, "orders"))
    return ix.fingerprint(cat.books, manifest).select("books", "mark", F.col("files").cast("long").alias("files"), (F.col("files") > 0).alias("any_file"), ((F.col("file_bytes") > 0) & F.col("file_newest").isNotNull()).alias("sized"))


CATALOG_GRAMS = ["title", "authors", "series", "keywords"]


def catalog_build(spark: SparkSession, cat: Catalog, root: str, books: DataFrame, force: bool = False, files: list[str] | None = None) -> dict:
    """Bring the catalog's index at root up to date with some of its books."""
    links = {
        "authors": (cat.author_links.join(cat.authors, "author_id"), "author_id", "last_name"),
        "series": (cat.series_links.join(cat.series, "series_id"), "series_id", "series_title"),
        "keywords": (cat.keyword_links, "keyword_id", "keyword_id"),
    }
    return ix.build_index(books.select("book_id", "update_id"), lambda since: ix.source_rows(books, links, cat.annotated, since), root, list(ix.WEIGHTS), CATALOG_GRAMS, force, files)


_INDEXED = f"""s as (select book_id, 'title' as field, {tok("title")} as t from books union all
   select book_id, 'authors', {tok("string_agg(last_name, ' ' order by ord, author_id)")} from author_links join authors using (author_id) where book_id in (select book_id from books) group by book_id union all
   select book_id, 'series', {tok("string_agg(s_name, ' ')")} from series_links join supplier on s_suppkey = series_id where book_id in (select book_id from books) group by book_id union all
   select book_id, 'keywords', {tok("string_agg(keyword_id, ' ')")} from keyword_links where book_id in (select book_id from books) group by book_id union all
   select l_orderkey, 'annotation', {tok("'a book of ' || count(*) || ' lines'")} from lineitem where l_orderkey in (select book_id from books) group by l_orderkey having count(*) > 3),
 p as (select distinct field, unnest(t) as term, book_id from s)"""


@query(f""", {_INDEXED} select field, term, count(*) as books from p group by all""")
def index_incremental(spark, d):
    """An index of the books up to a mark, brought up to date by a part with the later ones: as one full build."""
    cat, root = cat_of(spark, d), new_folder(spark, "index")
    catalog_build(spark, cat, root, cat.books.filter(F.col("update_id") <= MARK))
    catalog_build(spark, cat, root, cat.books)
    return ix.read_index(spark, root).postings.groupBy("field", "term").agg(F.count("*").alias("books"))


@query(f""", {_INDEXED}, o as (select count(*) as n from books where update_id <= {MARK}), c as (select count(*) as books, max(update_id) as mark from books),
 z as (select count(distinct book_id) as indexed, count(*) as forms from p), y as (select count(distinct p.book_id) as indexed, count(*) as forms from p join books using (book_id) where update_id <= {MARK})
 select 1 as step, 'full' as action, n as books, {MARK}::bigint as mark, 1 as parts, indexed, forms from o, y
 union all select 2, 'incremental', books, mark, 2, indexed, forms from c, z union all select 3, 'skipped', books, mark, 2, indexed, forms from c, z
 union all select 4, 'full', books, mark, 1, indexed, forms from c, z""")
def index_state(spark, d):
    """What the state says after a first build, an incremental one, one with nothing to do, and a forced one."""
    cat, root = cat_of(spark, d), new_folder(spark, "index")
    early = cat.books.filter(F.col("update_id") <= MARK)
    states = [catalog_build(spark, cat, root, early), *(catalog_build(spark, cat, root, cat.books, force) for force in (False, False, True))]
    rows = [(k, s["action"], s["books"], s["mark"], len(s["parts"]), s["indexed"], s["forms"]) for k, s in enumerate(states, 1)]
    return spark.createDataFrame(rows, "step int, action string, books long, mark long, parts int, indexed long, forms long")  # one row a step


_CHANGED = f"""src as (select doc_id as book_id, {TITLE} as title, annotation from (select doc_id, {{text}} as text, {{text}} as annotation from documents)),
toks as (select book_id, 'title' as field, {tok("title")} as t from src union all select book_id, 'annotation', {tok("annotation")} from src),
posts as (select distinct field, unnest(t) as term, book_id from toks)"""


def _changed(source: DataFrame, text) -> DataFrame:
    """The documents' source with other texts."""
    return source.select("book_id", "update_id", F.split(text, "\n")[0].alias("title"), text.alias("annotation"))


@query(f"with {_CHANGED.replace("{text}", "'exchanged ' || text")} select 'full' as action, field, term, count(*) as books, min(book_id) as least from posts group by all", base=False)
def index_rewritten(spark, d):
    """Files that are rewritten with as many books and the same mark: the index is built anew, not skipped."""
    folder, root = new_folder(spark, "input"), new_folder(spark, "index")
    docs = documents_source(spark, d)

    def build() -> dict:
        given = spark.read.schema(docs.schema).parquet(folder)
        return ix.build_index(given.select("book_id", "update_id"), lambda since: given, root, FIELDS, GRAM_FIELDS, files=[folder])

    docs.write.parquet(folder)
    first, second = build(), build()
    _changed(docs, F.concat(F.lit("exchanged "), "annotation")).write.mode("overwrite").parquet(folder)
    third = build()
    if (first["action"], second["action"]) != ("full", "skipped"):
        raise RuntimeError("the first build is full, a second one has nothing to do")
    found = ix.read_index(spark, root).postings.groupBy("field", "term").agg(F.count("*").alias("books"), F.min("book_id").alias("least"))
    return found.select(F.lit(third["action"]).alias("action"), "field", "term", "books", "least")


@query(f"""with {_CHANGED.replace("{text}", "case when doc_id % 5 = 0 then 'again ' || text when doc_id % 3 = 0 then 'newest ' || text else text end")}
 select field, term, count(*) as books, min(book_id) as least from posts group by all""", base=False)
def index_delivered(spark, d):
    """Deliveries: two versions of a book in one batch, books delivered again, late old versions, and a batch that is replayed."""
    root, docs = new_folder(spark, "index"), documents_source(spark, d)

    def version(books: str, update: int, word: str) -> DataFrame:
        return _changed(docs.filter(books).withColumn("update_id", F.lit(update).cast("long")), F.concat(F.lit(word), "annotation"))

    batches = [
        version("book_id % 3 > 0", 1, ""),
        version("book_id % 3 = 0", 3, "newest ").unionByName(version("book_id % 3 = 0", 2, "middle ")),
        version("book_id % 5 = 0", 5, "again "),
        version("book_id % 5 = 0", 4, "late "),
    ]
    for number, batch in [*enumerate(batches), (1, batches[1])]:
        ix.deliver(batch, root, FIELDS, GRAM_FIELDS, "deliveries", number)
    return ix.read_index(spark, root).postings.groupBy("field", "term").agg(F.count("*").alias("books"), F.min("book_id").alias("least"))


@query(f""", {_INDEXED} select book_id from p where field = 'authors' and term = 'ring' intersect select book_id from p where field = 'keywords' and term = 'economy' intersect select book_id from seen where year = 1997""")
def search_text_tree(spark, d):
    """Text leaves of the catalog's index inside a tree: an author's word and a keyword, and a year."""
    cat, index = catalog_index(spark, d)
    tree = {"and": [{"books": st.match(index, "Ring", "authors")}, {"books": st.match(index, "econ", "keywords", "prefix")}, {"number": "year", "op": "eq", "value": 1997}]}
    return match(cat, tree).select("book_id")


_WEIGHT = "case field " + " ".join(f"when '{f}' then {w}" for f, w in ix.WEIGHTS.items()) + " end"


@query(f""", {_INDEXED}, posts as materialized (select * from p), {_GAIN.format(f=f"select 0 as term, book_id, sum({_WEIGHT}) as f from posts where term = 'ring' group by all")}
 select book_id, title, -round(score, 6) as sort_key from g join seen using (book_id) order by sort_key, book_id limit 50""")
def sort_relevance(spark, d):
    """The best books for one word in any field, by weighted BM25."""
    cat, index = catalog_index(spark, d)
    keyed = st.by_relevance(match(cat, None), st.bm25(index, "ring"))
    return pg.page(keyed).select("book_id", "title", "sort_key")


def _by_relevance(spark, d, tree: dict) -> DataFrame:
    """The first page of a tree with text leaves by relevance, or by title where it can't be ranked."""
    cat, index = catalog_index(spark, d)
    return pg.page(st.by_relevance(match(cat, st.resolve(tree, index)), st.ranked(tree, index))).select("book_id", "title", "sort_key")


@query(f""", {_INDEXED}, posts as materialized (select * from p), {_GAIN.format(f="select 0 as term, book_id, 8 * count(*) as f from posts where field = 'authors' and starts_with(term, 'ri') group by all")}
 select book_id, title, -round(score, 6) as sort_key from g join seen using (book_id) order by sort_key, book_id limit 50""")
def sort_relevance_root(spark, d):
    """One text leaf as the root: ranked."""
    return _by_relevance(spark, d, {"text": "ri", "field": "authors", "op": "prefix"})


@query(f""", {_INDEXED} select book_id, title, search_title as sort_key from seen where book_id in (select book_id from p where term = 'ring') and book_id in (select book_id from p where field = 'keywords' and term = 'economy') order by search_title, book_id limit 50""")
def sort_relevance_two_leaves(spark, d):
    """Two text leaves: not ranked, so by title."""
    return _by_relevance(spark, d, {"and": [{"text": "ring"}, {"text": "economy", "field": "keywords"}]})


@query(" select book_id, title, search_title as sort_key from seen where year = 1996 order by search_title, book_id limit 50")
def sort_relevance_without_text(spark, d):
    keyed = st.by_relevance(match(cat_of(spark, d), {"number": "year", "op": "eq", "value": 1996}))
    return pg.page(keyed).select("book_id", "title", "sort_key")


@query("""select doc_id, length(t)::bigint as letters, case when length(t) = 0 then 0 else len(regexp_split_to_array(t, '\\s+')) end::bigint as words,
 case when length(t) = 0 then 0 else greatest(1, floor(length(t) / 2000 + 0.5)) end::bigint as pages from
 (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from documents)""", base=False)
def file_volume(spark, d):
    plain = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("t"))
    return plain.select("doc_id", *volume(F.col("t")))


@query("""select page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) as plain from pages""", base=False)
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("plain"))


@query("""select conv_id, role as name, lpad(turn::varchar, 6, '0') as time, t as text, row_number() over (partition by conv_id order by turn) as place from
 (select *, trim(text, chr(10) || chr(32) || chr(9) || chr(13)) as t from conversations) where t <> ''""", base=False)
def reviews_normalise(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.struct(F.col("role").alias("Nick"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("date"), F.regexp_replace("text", "\n", "<br/>").alias("Body")).alias("item"))
    files = turns.groupBy("conv_id").agg(F.to_json(F.collect_list("item")).alias("data"))  # a review file holds the turns of one conversation
    return normalise_reviews(files, "conv_id", "data")
