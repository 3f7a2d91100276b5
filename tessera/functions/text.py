"""Tokens, Russian stems and word forms; entity decoding and text volume."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Endings of the Russian stemmer, in the order of their public description.
GERUND_AFTER_A = ["в", "вши", "вшись"]
GERUND = ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"]
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_AFTER_A = ["ем", "нн", "вш", "ющ", "щ"]
PARTICIPLE = ["ивш", "ывш", "ующ"]
REFLEXIVE = ["ся", "сь"]
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = ["ейш", "ейше"]
DERIVATIONAL = ["ост", "ость"]
VOWELS = "аеиоуыэюя"


def _ending(endings: list[str], after_a: bool = False) -> re.Pattern:
    """Matches the longest of the endings (the leftmost match); after_a: only behind а or я within the region."""
    return re.compile(("(?<=[ая])" if after_a else "") + "(?:" + "|".join(endings) + ")$")


_GERUND, _ADJECTIVE = (_ending(GERUND_AFTER_A, True), _ending(GERUND)), _ending(ADJECTIVE)
_PARTICIPLE, _VERB = (_ending(PARTICIPLE_AFTER_A, True), _ending(PARTICIPLE)), (_ending(VERB_AFTER_A, True), _ending(VERB))
_REFLEXIVE, _NOUN, _SUPERLATIVE, _DERIVATIONAL = _ending(REFLEXIVE), _ending(NOUN), _ending(SUPERLATIVE), _ending(DERIVATIONAL)
_R1 = re.compile(f"[{VOWELS}][^{VOWELS}]")


def stem_word(word: str) -> str:
    """Words without Cyrillic letters and words of up to three letters stay as they are."""
    word = word.lower().replace("ё", "е")
    if len(word) <= 3 or not re.search("[а-я]", word):
        return word
    vowel = re.search(f"[{VOWELS}]", word)
    rv = vowel.end() if vowel else len(word)
    r1 = m.end() if (m := _R1.search(word)) else len(word)
    r2 = m.end() if (m := _R1.search(word, r1)) else len(word)
    head, tail = word[:rv], word[rv:]

    def without(text: str, *endings: re.Pattern) -> str | None:
        return next((text[: m.start()] for e in endings if (m := e.search(text))), None)

    done = without(tail, *_GERUND)
    if done is None:
        tail = _REFLEXIVE.sub("", tail)
        if (adjective := without(tail, _ADJECTIVE)) is not None:
            participle = without(adjective, *_PARTICIPLE)
            done = adjective if participle is None else participle
        else:
            done = next((x for x in (without(tail, *_VERB), without(tail, _NOUN)) if x is not None), tail)
    word = head + done.removesuffix("и")
    if (m := _DERIVATIONAL.search(word[r2:])) is not None:
        word = word[: r2 + m.start()]
    if word.endswith("нн"):
        return word[:-1]
    if (m := _SUPERLATIVE.search(word[rv:])) is not None:
        word = word[: rv + m.start()]
        return word[:-1] if word.endswith("нн") else word
    return word.removesuffix("ь")


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


def _folded() -> tuple[str, str]:
    """Latin letters with diacritics up to U+024F, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folded()


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits, ё as е; with fold, without Latin diacritics. Null: no token."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё" + (FOLD_FROM if fold else ""), "е" + (FOLD_TO if fold else ""))
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")


_FOLD = str.maketrans("ё" + FOLD_FROM, "е" + FOLD_TO)


def query_words(text: str) -> list[str]:
    """The folded tokens of a query text, in order: as tokens(fold=True), for a value of the driver."""
    return re.findall(r"[^\W_]+", text.lower().translate(_FOLD))


def word_forms(word: str) -> list[str]:
    """A token as it is and, where it differs, its stem."""
    return list(dict.fromkeys([word, stem_word(word)]))


def normalised(text: Column) -> Column:
    """Tokens between single spaces, one before and one after: phrases are substrings of it."""
    return F.concat(F.lit(" "), F.array_join(tokens(text, fold=True), " "), F.lit(" "))


def stems_of(words: DataFrame) -> DataFrame:
    """term and stem for the distinct terms whose stem differs: only Cyrillic words reach Python, each once."""
    return words.select("term").distinct().filter(F.col("term").rlike("[а-яё]")).withColumn("stem", stem("term")).filter("stem <> term")


@F.pandas_udf(ArrayType(StringType()))
def stems_of_words(words: pd.Series) -> pd.Series:
    """The stem of each word of an array; a batch stems each distinct word once."""
    known: dict[str, str] = {}

    def of(word: str) -> str:
        if word not in known:
            known[word] = stem_word(word)
        return known[word]

    return words.map(lambda ws: [of(w) for w in ws])


def stem_text(words: DataFrame, key: str, text: str) -> DataFrame:
    """key and stems: the tokens of a text by their stems, in order, joined by spaces; the distinct words are stemmed once."""
    each = words.select(key, F.posexplode_outer(tokens(F.col(text))).alias("at", "term"))
    stemmed = each.join(stems_of(each), "term", "left").select(key, "at", F.coalesce("stem", "term").alias("form"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "form"))))
    return stemmed.groupBy(key).agg(F.array_join(F.transform(in_order, lambda s: s["form"]), " ").alias("stems"))


def index_text(text: Column) -> Column:
    """The distinct forms of a text as the index holds them: each token followed by its stem, in the order first seen."""
    return _forms(tokens(text, fold=True))


@F.pandas_udf(ArrayType(StringType()))
def _forms(words: pd.Series) -> pd.Series:
    stems: dict[str, list[str]] = {}

    def of(word: str) -> list[str]:
        if word not in stems:
            stems[word] = word_forms(word)
        return stems[word]

    return words.map(lambda ws: list(dict.fromkeys(f for w in ws for f in of(w))))


#: Named entities that are decoded, in any case; others stay.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities decoded, each once: what one gives isn't decoded again."""

    def decoded(piece: Column) -> Column:
        entity = F.regexp_extract(piece, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);", 1)
        code = F.regexp_extract(entity, "^#(.*)$", 1)
        number = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).try_cast("long")
        valid = (code != "") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for name, value in ENTITIES.items():
            letter = F.coalesce(letter, F.when(F.lower(entity) == name, F.lit(value)))
        return F.when(letter.isNotNull(), F.concat(letter, F.substring(piece, F.length(entity) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), decoded), ""))


def strip_tags(html: Column) -> Column:
    """Text without tags, white space folded, entities decoded, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "), r"\s+", " ")
    return F.trim(decode_entities(plain))


CHARS_PER_PAGE = 2000


def volume(text: Column) -> list[Column]:
    """letters, words and pages of plain text."""
    letters = F.length(text)
    return [letters.cast("long").alias("letters"), F.when(letters == 0, 0).otherwise(F.size(F.split(text, r"\s+"))).cast("long").alias("words"), F.when(letters == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(letters / CHARS_PER_PAGE + 0.5))).cast("long").alias("pages")]
