"""Text search over a built index: match, prefix, phrase, substring, BM25, tables of queries, and the unindexed variant.

A query of one text is known to the driver, so its forms become filters that reach the scan of the sorted postings. A table
of queries is joined with them, each query by its rarest word first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalised, query_words, stems_of, tokens, word_forms
from tessera.operators.index import WEIGHTS, TextIndex
from tessera.sources.catalog import Catalog, author_name
from tessera.sources.storage import spread, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Books of a query's rarest word up to which they are broadcast to the other words' postings.
BROADCAST_BOOKS = 1_000_000
#: Distinct forms of a table of queries up to which they are broadcast to the scan of the postings.
BROADCAST_FORMS = 200_000


def _scoped(posts: DataFrame, field: str) -> DataFrame:
    return posts if field == "any" else posts.filter(F.col("field") == field)


def _is_form(forms: list[str], op: str) -> Column:
    """Whether a posting is of one of the forms, or begins with one."""
    return _any([F.col("term").startswith(f) for f in forms]) if op == "prefix" else F.col("term").isin(forms)


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _forms(text: str, op: str) -> list[list[str]]:
    """The forms of each word of a query; a phrase has raw words only."""
    words = query_words(text)
    if not words:
        raise ValueError("an empty text query")
    return [[w] if op == "phrase" else word_forms(w) for w in words]


def _found(index: TextIndex, words: list[list[str]], field: str, op: str) -> DataFrame:
    """The postings of the forms of several words. By the vocabulary, the books of the rarest word thin out the others' first."""
    posts, terms, held = _scoped(index.postings, field), _scoped(index.terms, field), [_is_form(fs, op) for fs in words]
    found = posts.filter(_is_form(sorted({f for fs in words for f in fs}), op))
    if len(words) == 1:
        return found
    counted = terms.agg(*(F.coalesce(F.sum(F.when(w, F.col("books"))), F.lit(0)).alias(f"n{k}") for k, w in enumerate(held))).first()
    rare = min(range(len(words)), key=lambda k: counted[k])
    if counted[rare] > BROADCAST_BOOKS:
        return found
    candidates = posts.filter(held[rare]).select("book_id").distinct()
    return found.join(F.broadcast(candidates), "book_id", "left_semi")  # at most as many rows as counted


def match(index: TextIndex, text: str, field: str = "any", op: str = "match") -> DataFrame:
    """book_id where every word occurs by some form (op match), or begins some form (op prefix); words may be in different fields if any.

    One filtered scan of the postings and one aggregate, for any number of words.
    """
    words = [list(fs) for fs in dict.fromkeys(map(tuple, _forms(text, op)))]
    found = _found(index, words, field, op)
    if len(words) == 1:
        return found.select("book_id").distinct()
    flags = [F.max(_is_form(fs, op).cast("int")).alias(f"w{k}") for k, fs in enumerate(words)]
    return found.groupBy("book_id").agg(*flags).filter(reduce(Column.__and__, [F.col(f"w{k}") == 1 for k in range(len(words))])).select("book_id")


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _phrase_counts(index: TextIndex, fields: list[str], text: str) -> DataFrame:
    """book_id, dl and how often the raw words of text stand next to each other in each field, by their positions alone."""
    words = query_words(text)
    if not words:
        raise ValueError("an empty text query")
    distinct = list(dict.fromkeys(words))
    posts = _found(index, [[w] for w in distinct], fields[0] if len(fields) == 1 else "any", "phrase").filter(F.col("field").isin(fields) & (F.size("positions") > 0))
    places = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(distinct)]  # one row each
    each = posts.groupBy("book_id", "field").agg(F.max("dl").alias("dl"), *places)
    begins = [_shifted(f"p{distinct.index(w)}", j) for j, w in enumerate(words)]
    counted = each.withColumn("n", F.coalesce(F.size(reduce(F.array_intersect, begins)), F.lit(0)))
    per_field = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).alias(f) for f in fields]
    return counted.filter("n > 0").groupBy("book_id").agg(F.max("dl").alias("dl"), *per_field)


def phrase(index: TextIndex, fields: list[str], text: str) -> DataFrame:
    """book_id and one count of occurrences for each field: books in which the raw words of text stand next to each other."""
    return _phrase_counts(index, fields, text).drop("dl")


def _piece_conditions(pieces: list[str]) -> list[Column]:
    """Of each word of a substring, whether a term can hold it: one word anywhere; of several, the first ends, the last begins and the others are terms."""
    term, last = F.col("term"), len(pieces) - 1
    if not last:
        return [term.contains(pieces[0])]
    return [term.endswith(w) if k == 0 else term.startswith(w) if k == last else term == w for k, w in enumerate(pieces)]


def substring(index: TextIndex, field: str, text: str) -> DataFrame:
    """Books whose normalised field holds the normalised text, which may cross words, by vocabulary and positions alone.

    The query is folded and cut into tokens as the field is; at least 3 characters must be left. The vocabulary is searched
    for the terms that can hold each word of the query, and counts their books; only those terms' postings are read, the books
    of the rarest word thin out the others', and shifted positions are intersected. No text and no gram is read.
    """
    pieces = query_words(text)
    if len(" ".join(pieces)) < 3 or field == "annotation":
        raise ValueError("a substring query needs 3 characters and a field other than annotation")
    held, last = _piece_conditions(pieces), len(pieces) - 1
    asked = written(index.terms.filter((F.col("field") == field) & _any(held)).groupBy("term").agg(F.sum("books").alias("books")), "asked")
    facts = asked.agg(F.count("*").alias("terms"), *(F.coalesce(F.sum(F.when(c, F.col("books"))), F.lit(0)).alias(f"n{k}") for k, c in enumerate(held))).first()
    posts = index.postings.filter((F.col("field") == field) & _any(held) & (F.size("positions") > 0))
    if facts["terms"] <= BROADCAST_FORMS:
        posts = posts.join(F.broadcast(asked.select("term")), "term", "left_semi")
    if not last:
        return posts.select("book_id").distinct()
    rare = min(range(len(pieces)), key=lambda k: facts[f"n{k}"])
    if facts[f"n{rare}"] <= BROADCAST_BOOKS:
        posts = posts.join(F.broadcast(posts.filter(held[rare]).select("book_id").distinct()), "book_id", "left_semi")
    # A book's positions of the terms of each word, as where the substring would begin.
    begins = [F.flatten(F.collect_list(F.when(c, _shifted("positions", k)))).alias(f"p{k}") for k, c in enumerate(held)]
    placed = posts.groupBy("book_id").agg(*begins)
    return placed.filter(F.size(reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(pieces))])) > 0).select("book_id")


def _holds(text: Column, query: str, op: str) -> Column:
    """Whether one text holds a query without an index: all words, prefixes or the phrase, without stems; or the upper-cased substring."""
    if op == "substring":
        return F.upper(F.coalesce(text, F.lit(""))).contains(query.upper())
    terms = [query_words(t) for t in query.replace(",", " ").replace(";", " ").split()]
    terms = [[w for ws in terms for w in ws]] if op == "phrase" else [ws for ws in terms if ws]
    if not any(terms):
        raise ValueError("an empty text query")
    padded = normalised(text)  # words of a term that a symbol parts stand next to each other
    return reduce(Column.__and__, [padded.contains(" " + " ".join(ws) + ("" if op == "prefix" else " ")) for ws in terms])


def unindexed(source: DataFrame, fields: list[str], text: str, op: str = "match") -> DataFrame:
    """Over columns of the books themselves: all words (or prefixes, or the phrase) in one field; any field of the list may do."""
    return source.filter(_any([_holds(F.col(f), text, op) for f in fields])).select("book_id")


def unindexed_catalog(cat: Catalog, field: str, text: str, op: str = "match", annotations: DataFrame | None = None) -> DataFrame:
    """book_id by title, author, series, keyword, annotation or any, before an index is built; all words in one row of one table.

    Keywords know prefixes and substrings of the whole name only. any: title for a substring, else all tables but keywords.
    """
    dictionaries = {"author": (cat.authors.select("author_id", author_name("list").alias("label")), cat.author_links), "series": (cat.series.select("series_id", F.col("series_title").alias("label")), cat.series_links)}

    def one(name: str) -> DataFrame:
        if name == "title":
            return cat.books.filter(_holds(F.col("title"), text, op)).select("book_id")
        if name == "annotation":
            if op == "substring" or annotations is None:
                raise ValueError("an annotation has no substring query, and needs its texts")
            return annotations.filter(_holds(F.col("annotation"), text, op)).select("book_id")
        if name == "keyword":
            label = F.upper(F.col("keyword_id").cast("string"))
            return cat.keyword_links.filter(label.contains(text.upper()) if op == "substring" else label.startswith(text.upper())).select("book_id")
        rows, links = dictionaries[name]
        return links.join(rows.filter(_holds(F.col("label"), text, op)), f"{name}_id", "left_semi").select("book_id")

    if field != "any":
        return one(field).distinct()
    names = ["title"] if op == "substring" else ["title", "author", "series", *(["annotation"] if annotations is not None else [])]
    return reduce(DataFrame.unionByName, map(one, names)).distinct()


def _idf(n: Column | int, n_books: int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.log((F.lit(n_books) - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))


def _gain(index: TextIndex, freq: DataFrame, by: str) -> DataFrame:
    """freq (by, book_id, dl, f) with gain: the BM25 part of each form in each book; every form's own idf, lengths over all fields."""
    held = freq.groupBy(by).agg(F.count("*").alias("n"))
    f, dl = F.col("f"), F.col("dl")
    gain = _idf(F.col("n"), index.n_books) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / index.average_size))
    return freq.join(F.broadcast(held), by).select(by, "book_id", gain.alias("gain"))  # held: a row for each form of the query


def _weight(column: str = "field") -> Column:
    return reduce(lambda c, x: F.when(F.col(column) == x[0], x[1]).otherwise(c), WEIGHTS.items(), F.lit(0))


def bm25(index: TextIndex, text: str, field: str = "any", op: str = "match", fields: list[str] | None = None) -> DataFrame:
    """book_id and score of the books that match (op match, prefix, or phrase within fields); higher is better.

    A form counts once for each field and term that holds it, times the field's weight; a phrase by its occurrences. Lengths
    come with the postings. Any number of words.
    """
    if op == "phrase":
        scope = fields or (list(WEIGHTS) if field == "any" else [field])
        freq = _phrase_counts(index, scope, text).select(F.lit(0).alias("form"), "book_id", "dl", reduce(Column.__add__, [F.col(f) * WEIGHTS[f] for f in scope]).alias("f"))
        return _gain(index, freq, "form").select("book_id", F.col("gain").alias("score"))
    words = _forms(text, op)
    flat = [(k, f) for k, fs in enumerate(words) for f in fs]
    if op == "prefix":
        which = F.array_compact(F.array(*(F.when(F.col("term").startswith(f), i) for i, (_, f) in enumerate(flat))))
    else:
        places: dict[str, list[int]] = {}
        for i, (_, f) in enumerate(flat):
            places.setdefault(f, []).append(i)
        which = F.element_at(F.create_map(*(c for f, at in places.items() for c in (F.lit(f), F.array(*map(F.lit, at))))), F.col("term"))
    posts = _scoped(index.postings, field).filter(_is_form(sorted({f for _, f in flat}), op))  # all of them: a form's idf counts every book
    freq = posts.select(F.explode(which).alias("form"), "book_id", "dl", _weight().alias("w")).groupBy("form", "book_id").agg(F.sum("w").alias("f"), F.max("dl").alias("dl"))
    word = F.get(F.array(*(F.lit(k) for k, _ in flat)), F.col("form"))
    per_book = _gain(index, freq, "form").groupBy("book_id").agg(F.sum("gain").alias("score"), F.size(F.collect_set(word)).alias("words"))
    return per_book.filter(F.col("words") == len(words)).select("book_id", "score")


def found(leaf: dict, index: TextIndex) -> DataFrame:
    """book_id of a text leaf {"text": words, "field": any or one, "op": match, prefix, phrase or substring}."""
    text, field, op = leaf["text"], leaf.get("field", "any"), leaf.get("op", "match")
    if op == "substring":
        return substring(index, field, text)
    if op == "phrase":
        return phrase(index, list(WEIGHTS) if field == "any" else [field], text).select("book_id")
    return match(index, text, field, op)


def resolve(tree: dict, index: TextIndex) -> dict:
    """A predicate tree with its text leaves answered by the index."""
    if "text" in tree:
        return {"books": found(tree, index)}
    if "not" in tree:
        return {"not": resolve(tree["not"], index)}
    for both in ("and", "or"):
        if both in tree:
            return {both: [resolve(x, index) for x in tree[both]]}
    return tree


def ranked(tree: dict, index: TextIndex) -> DataFrame | None:
    """The scores of a tree that can be ordered by relevance: one text leaf as the root, not by substring; else None."""
    if set(tree) & {"and", "or", "not"} or "text" not in tree or tree.get("op", "match") == "substring":
        return None
    return bm25(index, tree["text"], tree.get("field", "any"), tree.get("op", "match"))


def by_relevance(matched: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """matched with sort_key, to be paged in ascending order: best scores first; without scores by title."""
    if scored is None:
        return matched.withColumn("sort_key", F.coalesce("search_title", F.lit("")))
    return matched.join(scored.select("book_id", (-F.round("score", 6)).alias("sort_key")), "book_id")


def query_forms(queries: DataFrame) -> DataFrame:
    """query_id, word_no, form for a table (query_id, text): every word as it is and by its stem."""
    words = queries.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("text"), fold=True))).alias("word_no", "term"))
    stems = words.join(stems_of(words), "term").select("query_id", "word_no", F.col("stem").alias("form"))
    return words.select("query_id", "word_no", F.col("term").alias("form")).unionByName(stems).distinct()


def search(queries: DataFrame, index: TextIndex, field: str = "any", prefix: bool = False) -> DataFrame:
    """(query_id, book_id) where every word of the query matches by some form; words may match in different fields if any.

    A word is the set of its forms, and the books of each distinct word are found once, however many queries hold it; prefixes
    are expanded over the vocabulary by distinct words, too. The rarest word of a query, by the vocabulary, gives its
    candidates; the other words look up (word, book) pairs. The postings are read once, and only those of the terms asked leave
    the scan. Each pair comes once by construction, so results aren't made distinct.
    """
    words = query_forms(queries).groupBy("query_id", "word_no").agg(F.array_join(F.array_sort(F.collect_set("form")), " ").alias("word"))  # no form holds a space
    words = written(words.select("query_id", "word").distinct(), "words")
    forms = words.select("word").distinct().select("word", F.explode(F.split("word", " ")).alias("form"))
    terms = _scoped(index.terms, field).groupBy("term").agg(F.sum("books").alias("books"))
    # For prefixes every beginning of a vocabulary word is a key: an equi-join, at most a word's length times the vocabulary.
    keys = F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.left(F.col("term"), k))) if prefix else F.col("term")
    asked = written(forms.join(terms.select("term", "books", keys.alias("form")), "form").select("word", "term", "books").distinct(), "asked")
    plan = words.join(asked.groupBy("word").agg(F.sum("books").alias("books")), "word", "left").groupBy("query_id").agg(
        F.min_by("word", F.struct("books", "word")).alias("word"), F.count("*").alias("words"), F.count("books").alias("held"))
    plan = written(plan.filter("held = words").select("query_id", "word", "words"), "plan")  # a word outside the vocabulary: no match
    pairs, posts = asked.select("word", "term"), _scoped(index.postings, field).select("term", "book_id")
    few = pairs.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
    held = written(posts.join(F.broadcast(pairs) if few else pairs, "term").select("word", "book_id").distinct(), "held")
    # The books of a word that many queries hold: where these are broadcast, they meet its books wherever those lie.
    asking = F.broadcast(plan) if plan.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS else plan
    first = spread(held).join(asking, "word").select("query_id", F.col("word").alias("rarest"), "words", "book_id")
    rest = first.filter("words > 1").join(words, "query_id").filter("word <> rarest").join(held, ["word", "book_id"])
    got = rest.groupBy("query_id", "book_id", "words").agg(F.count("*").alias("got")).filter("got = words - 1").select("query_id", "book_id")
    return first.filter("words = 1").select("query_id", "book_id").unionByName(got)
