"""Secret scans by an incremental blob ledger: every version of every path is addressed by its content, only unseen pairs of
blob and rule version are scanned, and the findings are joined back to all paths.

A ledger is a folder of Parquet files, one row for each blob and run: blob (sha256 of the text in UTF-8), rules (the rule
versions scanned then) and found (spans: rule, start, end in code points, end exclusive). A run appends; it commits all its
files at once or none, so a run that dies is simply repeated, and a blob that two runs scanned is read once. A rule's
version holds a hash of its definition: a changed rule is a new version, and only it is scanned again.

Null texts are the empty blob. Null ids pass through, repeated rows each get their row, an empty table gives none; very long
texts are scanned whole. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, join_sized, new_folder, rows_per_task, ship


class Rule(NamedTuple):
    """A pattern; matches whose group has fewer characters than least are dropped. hints: one of them, in lower case, is in every match."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...]
    any_case: bool = False

    @property
    def version(self) -> str:
        return f"{self.name}:{hashlib.sha256(repr(tuple(self)).encode()).hexdigest()[:12]}"


#: The rules, in the order in which spans at the same place are listed. The first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, ()),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1, ("private key",)),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1, ("gh", "xox", "sk_live_", "aiza")),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 1, ("://",), True),
)
BASE = ("assign", "access", "hex")
_FOUND = "array<struct<rule:string,start:int,`end`:int>>"


class Scanner:
    """The patterns of some rules over one text."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, re.A | (re.I if r.any_case else 0))) for r in rules]

    def scan(self, text: str, versions: list[str]) -> list[tuple[str, int, int]]:
        low, found = text.lower(), []
        for rule, pattern in self.rules:
            if rule.version in versions and (not rule.hints or any(h in low for h in rule.hints)):
                found += [(rule.name, *m.span()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return found


def blob_of(text: str = "text") -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob string, rules array<string>, found {_FOUND}").parquet(ledger)
    except AnalysisException:
        return None


def unseen(texts: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob, text and todo (rule versions): each distinct blob that some rule version hasn't scanned.

    Copies are thinned out within each task before their blob is shuffled, so a hot blob sends one row a task.
    """
    blobs = texts.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    all_rules = F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", all_rules)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # a row for each run of a blob
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.filter(F.size("todo") > 0).select("blob", "text", "todo")


def update_ledger(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan what the ledger at that path lacks of the texts, and append it."""
    spark = texts.sparkSession
    ship(spark)

    def run(batches):
        scanner = Scanner(rules)
        for whole in batches:
            for batch in rows_per_task(whole, "text"):
                blobs, plain, todo = batch.columns
                spans = [[{"rule": k, "start": a, "end": b} for k, a, b in scanner.scan(t, v)] for t, v in zip(plain.to_pylist(), todo.to_pylist(), strict=True)]
                kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([blobs, todo, pa.array(spans, kind)], ["blob", "rules", "found"])

    fresh = unseen(texts, read_ledger(spark, ledger), rules, text)
    fresh.mapInArrow(run, f"blob string, rules array<string>, found {_FOUND}").write.mode("append").parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and found: the spans of the given rules in each blob that has any, by start, then in the order of the rules."""
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))))
    place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    # Of each blob's runs, a rule's spans come from one that scanned its present version.
    wanted = F.transform(F.filter("rules", lambda v: order[v].isNotNull()), lambda v: F.substring_index(v, ":", 1))
    mine = F.filter("found", lambda s: F.array_contains(wanted, s["rule"]))
    rows = ledger.select("blob", mine.alias("found")).filter(F.size("found") > 0)
    each = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), place[s["rule"]].alias("place"), s["end"].alias("end"), s["rule"].alias("rule"))))
    return each.select("blob", F.transform(ordered, lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))


def scan(versions: DataFrame, ledger: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of keep, blob and found (null without findings) for every row of versions, by way of the ledger.

    Paths carry no text. A blob of many paths is joined where they lie.
    """
    update_ledger(versions, ledger, rules, text)
    paths = cut(versions.select(*keep, blob_of(text).alias("blob")), "paths")
    copies = paths.groupBy("blob").agg(F.count("*").alias("copies_"))
    found = cut(findings(read_ledger(versions.sparkSession, ledger), rules).join(copies, "blob"), "found")
    return join_sized(paths, found, "blob", "copies_", "left").select(*keep, "blob", "found")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.coalesce(found, F.array().cast(_FOUND)), lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scanned = scan(docs, new_folder(spark, "ledger"))
    base = F.filter("found", lambda s: s["rule"].isin(*BASE))

    def n(kind: str) -> Column:
        return F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size(F.filter("found", lambda s: s["rule"] == kind))).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(n, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql_spans(rule: Rule, place: int) -> str:
    """Spans of one rule: matches are marked, and what lies before each mark is counted."""
    pattern = rule.pattern.replace("(?<![0-9a-f])[0-9a-f]{16,}", "[0-9a-f]+").replace("'", "''")
    held = rf"regexp_extract(m, '{pattern}', {rule.group}{", 'i'" if rule.any_case else ""})"
    return rf"""select r, '{rule.name}' as kind, {place} as place, start, start + len(m) as stop from (
  select r, split_part(p[k], chr(2), 1) as m, list_sum([len(x) for x in p[1:k - 1]])::bigint - (k - 2) as start
  from (select r, p, unnest(range(2, len(p) + 1)) as k from (select r, string_split(regexp_replace(t, '({pattern})', chr(1) || '\1' || chr(2), 'g{"i" if rule.any_case else ""}'), chr(1)) as p from docs)))
  where len({held}) >= {rule.least}"""


#: DuckDB folds two characters beyond ASCII to s and k, so they are made others first.
ORACLE_SQL = f"""
with docs as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '\u017f\u212a', '¤¤') as t from documents),
spans as ({" union all ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
told as (select r, string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (place < 3) as base,
  {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)} from spans group by 1)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join told using (r)"""
