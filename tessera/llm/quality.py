"""Quality rules: a threshold table compiled into one Spark projection, with built-in functions only.

Words are maximal runs of characters other than space and U+0009..U+000D. Null text counts as text without words.
Null ids pass through; repeated rows give repeated results; other columns of the input are not read. Very long texts are
measured whole; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of the four languages that the rules know.
STOP_WORDS = (
    "a an and are as at be by for from have in is it not of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans de des du elle en est et il la le les pour que qui sur un une "
    "al como con del el es las los lo no para por se su una y"
).split()


class Rule(NamedTuple):
    """A ratio of two measures with inclusive bounds; a zero denominator makes the ratio 0."""

    name: str
    over: str
    under: str
    low: float | None
    high: float | None


#: The threshold table. Ratios are compared by cross-multiplication of integers, so verdicts are exact.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 12),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_line_ratio", "n_dup_lines", "n_lines", None, 0.35),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: {text} is an attribute. Values are bound by transform(array(value), name -> ...)[0], so none is computed twice.
#: A window is packed as (hash of its words, position): after a sort, equal windows are neighbours, and the words
#: of neighbours are compared again. Cost is n log n for a text of n words, and memory follows its length.
MEASURES = r"""
transform(array(coalesce({text}, '')), t ->
transform(array(array_remove(split(t, r'[\x20\x09-\x0D]+'), '')), w ->
transform(array(filter(split(t, r'\n'), x -> x rlike r'[^\x20\x09-\x0D]')), ln ->
named_struct(
  'n_words', cast(size(w) as bigint),
  'word_chars', cast(length(translate(t, ' \t\n\u000b\u000c\r', '')) as bigint),
  'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint),
  'n_lines', cast(size(ln) as bigint),
  'n_dup_lines', cast(size(ln) - size(array_distinct(ln)) as bigint),
  'n_stop_words', cast(size(filter(w, x -> lower(x) in ({stops}))) as bigint),
  'n_repeat_words', case when size(w) < 4 then 0L else
    transform(array(cast(ceil(log2(size(w) + 1)) as int)), b ->
    transform(array(sort_array(transform(sequence(0, size(w) - 3),
        i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint)))), s ->
    aggregate(
      array_sort(transform(
        filter(sequence(0, size(s) - 1), k -> {same_before} or {same_after}),
        k -> cast(s[k] & (shiftleft(1L, b) - 1L) as int))),
      named_struct('total', 0L, 'last', -3),
      (acc, p) -> named_struct('total', acc.total + least(3, p - acc.last), 'last', p),
      acc -> acc.total)
    )[0])[0] end
))[0])[0])[0]
"""
_PAIR = (
    "({guard} and shiftrightunsigned(s[k], b) = shiftrightunsigned(s[{other}], b)"
    " and w[cast(s[k] & (shiftleft(1L, b) - 1L) as int)] = w[cast(s[{other}] & (shiftleft(1L, b) - 1L) as int)]"
    " and w[cast(s[k] & (shiftleft(1L, b) - 1L) as int) + 1] = w[cast(s[{other}] & (shiftleft(1L, b) - 1L) as int) + 1]"
    " and w[cast(s[k] & (shiftleft(1L, b) - 1L) as int) + 2] = w[cast(s[{other}] & (shiftleft(1L, b) - 1L) as int) + 2])"
)


def measures(text: str) -> Column:
    """A struct of the base counts of a text column, named by an SQL attribute."""
    stops = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    return F.expr(
        MEASURES.format(
            text=text,
            stops=stops,
            same_before=_PAIR.format(guard="k > 0", other="k - 1"),
            same_after=_PAIR.format(guard="k + 1 < size(s)", other="k + 1"),
        )
    )


def compile_rules(rules: tuple[Rule, ...] = RULES, measure: Callable[[str], Column] = F.col) -> Column:
    """All rules as one boolean expression over the measures, by name; true where every rule holds."""
    verdict = F.lit(True)
    for rule in rules:
        over, under = measure(rule.over), measure(rule.under)
        if rule.low is not None:
            verdict = verdict & (over * 1000 >= under * round(rule.low * 1000))
        if rule.high is not None:
            verdict = verdict & (over * 1000 <= under * round(rule.high * 1000))
    return verdict


def fails_base(measure: Callable[[str], Column] = F.col) -> Column:
    return (measure("n_words") < MIN_WORDS) | (100 * measure("n_repeat_words") > MAX_REPEAT_PERCENT * measure("n_words"))


def score_quality(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of keep, the measures, base_failed and kept, one row for each input row; a narrow projection."""
    counted = df.select(*keep, measures(f"`{text}`").alias("m_"))
    flat = counted.select(*keep, "m_.*")
    return flat.withColumn("base_failed", fails_base()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all rules, with the columns of the input, whatever their names; null texts go, null ids and repeated rows are judged each."""
    # No column is added, so none of the input can clash with the measures' names.
    verdict = F.transform(F.array(measures("`text`")), lambda m: ~fails_base(m.getField) & compile_rules(RULES, m.getField))
    return docs.filter(verdict[0])


_SQL_GAP = r"[\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select doc_id, r, t, list_filter(regexp_split_to_array(t, '{_SQL_GAP}'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln from d),
p as (select r, unnest(generate_series(1, len(w) - 2)) as i, w from w where len(w) >= 3),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from p),
h as (select r, i, count(*) over (partition by r, a, b, c) as n from g),
v as (select distinct r, unnest([i, i + 1, i + 2]) as at from h where n > 1),
q as (select r, count(*) as n from v group by r),
m as (select w.doc_id, len(w)::bigint as n_words,
        length(regexp_replace(t, '{_SQL_GAP}', '', 'g'))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        len(ln)::bigint as n_lines, (len(ln) - len(list_distinct(ln)))::bigint as n_dup_lines,
        len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))})))::bigint as n_stop_words,
        coalesce(q.n, 0)::bigint as n_repeat_words
      from w left join q using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and word_chars * 1000 >= n_words * 2000 and word_chars * 1000 <= n_words * 12000
  and n_symbols * 1000 <= n_words * 100 and n_stop_words * 1000 >= n_words * 50
  and n_dup_lines * 1000 <= n_lines * 350 as kept from f
"""
