"""Text index as tables: postings with positions, vocabulary, books, grams; parts under a state, merged in tiers.

An index is a folder. A build or a delivery writes new part folders and then, as its last act, adds one state file that
names the parts in force; readers take the newest state. Nothing is overwritten or deleted, so a build that dies leaves the
index as it was, and readers of an older state go on undisturbed.

A later part replaces what earlier parts say of its books: it carries the ids that it replaces (its tombstones), and readers
leave those out of the parts before it. FANOUT parts of one level become one part of the next level, so the number of parts
grows with the logarithm of the number of deliveries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalised, stems_of_words, tokens
from tessera.sources.storage import file_manifest, spread, written

#: Weights of the fields.
WEIGHTS = {"title": 10, "authors": 8, "series": 4, "keywords": 2, "annotation": 1}
#: Parts of a level that are merged into one of the next; level of a full build, which deliveries don't reach.
FANOUT, FULL_LEVEL = 4, 60
#: Rows of a table up to which one task sorts and writes it; ids up to which a set of books is broadcast.
ONE_TASK_ROWS, BROADCAST_IDS = 200_000, 1_000_000
#: Letters of a block of texts whose grams are listed together; books of a list where parts are merged.
BLOCK_LETTERS, LIST_BOOKS = 1 << 20, 100_000
#: Of the tables below; part of a state.
LAYOUT = 2
#: Of the sorted tables: ids of a list are stored by their differences, not by a dictionary.
PACKED = {"parquet.writer.version": "v2", "compression": "zstd", "parquet.enable.dictionary#books.list.element": "false"}
TABLES = {
    "postings": "term string, book_id long, dl long, positions array<int>, field string",
    "terms": "term string, books long, field string",
    "books": "book_id long, update_id long, dl long",
    "grams": "gram string, books array<long>, field string",
    "gone": "book_id long",
}


def source_rows(books: DataFrame, links: dict[str, tuple[DataFrame, str, str]], annotations: DataFrame | None = None, since: int | None = None) -> DataFrame:
    """book_id, update_id, title and one text for each linked field (names in link order), optionally newer than a mark.

    links: field to (link table with ord joined to its dictionary, key, label). Books, links and annotations meet in one
    aggregate by book, so each is shuffled once (by its rows: most partial aggregates would hold one link).
    """
    rows = books.select("book_id", F.struct("update_id", "title").alias("own"))
    rows = rows if since is None else rows.filter(F.col("own.update_id") > since)
    within = lambda df: df if since is None else df.join(rows.select("book_id"), "book_id", "left_semi")
    each = [rows]
    for no, (named, key, label) in enumerate(links.values()):
        each.append(within(named.select("book_id", F.lit(no).alias("no"), "ord", F.col(key).alias(f"key{no}"), F.col(label).cast("string").alias("x"))))
    if annotations is not None:
        each.append(within(annotations.select("book_id", "annotation")))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    facts = [F.first("own", ignorenulls=True).alias("own")]
    if links:
        link = F.struct("no", "ord", *(f"key{no}" for no in range(len(links))), "x")
        facts.append(F.array_sort(F.collect_list(F.when(F.col("no").isNotNull(), link))).alias("links"))
    if annotations is not None:
        facts.append(F.first("annotation", ignorenulls=True).alias("annotation"))
    met = together.repartition("book_id").groupBy("book_id").agg(*facts).filter("own is not null")  # links of no book vanish

    def text(no: int) -> Column:
        return F.array_join(F.transform(F.filter("links", lambda s: s["no"] == no), lambda s: s["x"]), " ")

    texts = [text(no).alias(field) for no, field in enumerate(links)]
    found = met.select("book_id", "own.update_id", "own.title", *texts, *(["annotation"] if annotations is not None else []))
    return found.sortWithinPartitions("book_id")  # near ids stand together in the lists of grams, which are stored by differences


def _placed(words: Column) -> Column:
    """An array of (term, positions) for an array of tokens: where tokens repeat, sorted once and cut where the term changes."""

    def cut(s: Column) -> Column:
        term = lambda k: F.get(s, k)["term"]
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (term(k) != term(k - 1)))

        def entries(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(s))
            return F.transform(at, lambda k, j: F.struct(term(k).alias("term"), F.transform(F.slice(s, k + 1, end(j) - k), lambda x: x["at"]).alias("positions")))

        return F.transform(F.array(starts), entries)[0]

    in_order = F.array_sort(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("at"))))
    once = F.transform(words, lambda t, i: F.struct(t.alias("term"), F.array(i).alias("positions")))
    return F.when(F.size(F.array_distinct(words)) == F.size(words), once).otherwise(F.transform(F.array(in_order), cut)[0])  # bound once


def _dl(count: int) -> Column:
    return reduce(Column.__add__, [F.size(f"f{k}") for k in range(count)]).cast("long")


def cut_books(source: DataFrame, fields: list[str], gram_fields: list[str]) -> DataFrame:
    """A row for each book, by a narrow step: book_id, update_id, dl (its tokens' terms over all fields), f0, f1, ... (of each
    field an array of term and positions), g0, g1, ... (the normalised text of each gram field), and cyrillic, whether any
    word has to be stemmed."""
    update = F.col("update_id") if "update_id" in source.columns else F.lit(None).cast("long")
    named = list(dict.fromkeys([*fields, *gram_fields]))
    cyrillic = reduce(Column.__or__, [F.lower(F.coalesce(F.col(f), F.lit(""))).rlike("[а-яё]") for f in fields])
    words = source.select("book_id", update.alias("update_id"), *(tokens(F.col(f), fold=True).alias(f"w{k}") for k, f in enumerate(named)), cyrillic.alias("cyrillic"))
    texts = [F.array_join(f"w{named.index(f)}", " ").alias(f"g{k}") for k, f in enumerate(gram_fields)]
    placed = words.select("book_id", "update_id", *(_placed(F.col(f"w{k}")).alias(f"f{k}") for k in range(len(fields))), *texts, "cyrillic")
    return placed.withColumn("dl", _dl(len(fields)))


def with_stems(cut: DataFrame, count: int) -> DataFrame:
    """cut with the stems that aren't tokens of their field as terms without positions; only Cyrillic words leave the JVM."""
    cyrillic = [F.filter(F.transform(f"f{k}", lambda x: x["term"]), lambda t: t.rlike("[а-яё]")) for k in range(count)]
    more = cut.select("*", *(stems_of_words(c).alias(f"s{k}") for k, c in enumerate(cyrillic)))

    def both(k: int) -> Column:
        new = F.array_except(F.array_distinct(f"s{k}"), F.transform(f"f{k}", lambda x: x["term"]))
        return F.concat(f"f{k}", F.transform(new, lambda t: F.struct(t.alias("term"), F.array().cast("array<int>").alias("positions"))))

    return more.withColumns({f"f{k}": both(k) for k in range(count)}).withColumn("dl", _dl(count)).select(*cut.columns)


def forms(cut: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, book_id, dl, positions: tokens, with their positions, and stems, without; dl counts a book's forms over all fields."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{k}").alias("x")) for k, f in enumerate(fields)))
    rows = cut.select("book_id", "dl", F.explode(each).alias("e")).select("book_id", "dl", "e.field", F.explode("e.x").alias("x"))
    return rows.select("field", "x.term", "book_id", "dl", "x.positions")


def postings(source: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, book_id: the distinct forms (tokens and stems) of each field of each book, without their positions."""
    cut = spread(source).select("book_id", *(F.array_distinct(tokens(F.col(f), fold=True)).alias(f"f{k}") for k, f in enumerate(fields)))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{k}").alias("words")) for k, f in enumerate(fields)))
    rows = cut.select("book_id", F.explode(each).alias("e")).select("book_id", "e.field", "e.words")
    stems = stems_of_words(F.filter("words", lambda t: t.rlike("[а-яё]")))  # only Cyrillic words leave the JVM
    return rows.select("field", F.explode(F.array_union("words", stems)).alias("term"), "book_id")


def grams(source: DataFrame, fields: list[str], n: int = 3) -> DataFrame:
    """field, gram, book_id over the normalised text, distinct."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(normalised(F.col(f))).alias("t")) for f in fields))
    texts = source.select("book_id", F.explode(each).alias("x")).select("book_id", "x.field", "x.t").filter(F.length("t") >= n)

    def pieces(letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(letters) - n), lambda i: F.concat(*(F.get(letters, i + k) for k in range(n))))

    cut = F.array_distinct(F.transform(F.array(F.filter(F.split("t", ""), lambda c: c != "")), pieces)[0])  # the letters are bound once
    return texts.select("field", F.explode(cut).alias("gram"), "book_id")


def gram_lists(cut: DataFrame, gram_fields: list[str]) -> DataFrame:
    """field, gram and the books that hold it, a row for each gram in a block of books; the rows of grams, without their shuffle."""
    texts = [f"g{k}" for k in range(len(gram_fields))]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("book_id").to_numpy()
            for name, field in zip(texts, gram_fields, strict=True):
                lengths = pc.utf8_length(batch.column(name)).to_numpy().astype(np.int64)
                block = np.cumsum(lengths) // BLOCK_LETTERS
                for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(block)) + 1):
                    if len(rows):
                        yield _listed(ids[rows], batch.column(name).slice(int(rows[0]), len(rows)).to_pylist(), lengths[rows], field)

    return cut.select("book_id", *texts).mapInArrow(lists, "field string, gram string, books array<long>")


def _listed(ids: np.ndarray, texts: list[str], lengths: np.ndarray, field: str) -> pa.RecordBatch:
    """The distinct runs of three letters of some texts, each with the ids of those that hold it, in order."""
    order, n = np.argsort(ids, kind="stable"), len(ids)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.repeat(place, lengths)
    whole = at[2:] == at[:-2]  # runs that don't leave their text
    runs = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[whole]
    distinct, no = np.unique(runs, return_inverse=True)
    pairs = np.unique(no * n + at[:-2][whole])
    starts = np.searchsorted(pairs, np.arange(len(distinct) + 1) * n)
    grams = np.stack([distinct >> 42, distinct >> 21 & 0x1FFFFF, distinct & 0x1FFFFF], axis=1).astype("<u4")
    names = grams.view("<U3").ravel().tolist() if len(grams) else []
    books = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids[order][pairs % n], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([field] * len(names), pa.string()), pa.array(names, pa.string()), books], names=["field", "gram", "books"])


def fingerprint(books: DataFrame, manifest: dict | None = None) -> DataFrame:
    """One row: books, mark (largest update id), and what file_manifest says of the files read, where given."""
    facts = [F.lit(manifest[k]).alias(f"file_{k}" if k != "files" else k) for k in ("files", "bytes", "newest", "digest")] if manifest else []
    return books.agg(F.count("*").alias("books"), F.max("update_id").alias("mark")).select("*", *facts)


def decide(books: DataFrame, state: dict | None, force: bool = False, manifest: dict | None = None) -> DataFrame:
    """One row: action (skipped, incremental, full), since, and the state to save (books, mark).

    Skipped only where the number of books, the mark and, where given, the manifest are those of the state. Incremental only
    where the mark grew and the number of books up to the old mark is unchanged. So files rewritten with as many books and
    the same mark give a full build.
    """
    old_mark, old_count = (state["mark"], state["books"]) if state else (None, None)
    now = books.agg(F.count("*").alias("books"), F.max("update_id").alias("mark"), F.count(F.when(F.col("update_id") <= F.lit(old_mark), 1)).alias("below"))
    if state is None or force:
        action = F.lit("full")
    else:
        same_files = F.lit(manifest is None or state.get("manifest") == manifest)
        same = (F.col("books") == old_count) & F.col("mark").eqNullSafe(F.lit(old_mark).cast("long")) & same_files
        action = F.when(same, "skipped").when((F.col("mark") > old_mark) & (F.col("below") == old_count), "incremental").otherwise("full")
    return now.select(action.alias("action"), F.when(action == "incremental", F.lit(old_mark)).cast("long").alias("since"), "books", "mark")


def _within(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


@dataclass
class TextIndex:
    """The tables of an index at one state, without what later parts replace."""

    spark: SparkSession
    root: str
    state: dict

    def table(self, name: str) -> DataFrame:
        """postings, books or grams, a row for each book, of all books in force. Parts between which nothing was replaced are one scan."""
        groups: list[list[dict]] = []
        for part in self.state["parts"]:
            if part["gone"] or not groups:
                groups.append([])
            groups[-1].append(part)
        return reduce(DataFrame.unionByName, (self._left(_read(self.spark, self.root, group, name), groups[k + 1 :]) for k, group in enumerate(groups))) if groups else _read(self.spark, self.root, [], name)

    def _left(self, rows: DataFrame, later: list[list[dict]]) -> DataFrame:
        replacing = [part for group in later for part in group if part["gone"]]
        if not replacing:
            return rows
        gone = _read(self.spark, self.root, replacing, "gone").distinct()
        return rows.join(_within(gone, sum(p["gone"] for p in replacing)), "book_id", "left_anti")

    @property
    def postings(self) -> DataFrame:  # field, term, book_id, dl, positions
        return self.table("postings")

    @property
    def grams(self) -> DataFrame:  # field, gram, book_id
        """A filter on gram reaches the scan of the lists."""
        return self.table("grams")

    @property
    def books(self) -> DataFrame:  # book_id, update_id, dl
        return self.table("books")

    @property
    def sizes(self) -> DataFrame:
        """book_id and dl, forms over all fields, of the books that have any."""
        return self.books.filter("dl > 0").select("book_id", "dl")

    @property
    def terms(self) -> DataFrame:
        """field, term, books, in one row or, over several parts, in some. Replaced books count until their part is merged: for planning."""
        return _read(self.spark, self.root, self.state["parts"], "terms")

    def vocabulary(self) -> DataFrame:
        """field, term and the exact number of books: from the written counts, or from the postings where books were replaced."""
        if any(p["gone"] for p in self.state["parts"]):
            return self.postings.groupBy("field", "term").agg(F.count("*").alias("books"))
        return self.terms.groupBy("field", "term").agg(F.sum("books").alias("books"))

    @property
    def n_books(self) -> int:
        """Books with a form."""
        return self.state["indexed"]

    @property
    def average_size(self) -> float:
        return self.state["forms"] / max(1, self.n_books)


def _read(spark: SparkSession, root: str, parts: list[dict], name: str) -> DataFrame:
    paths = [_path(root, p["folder"], name) for p in parts]
    found = spark.read.schema(f"{TABLES[name]}, part string").option("basePath", f"{root}/{name}").parquet(*paths).drop("part") if parts else spark.createDataFrame([], TABLES[name])
    return found.select("gram", F.explode("books").alias("book_id"), "field") if name == "grams" else found


def _path(root: str, folder: str, name: str) -> str:
    return f"{root}/{name}/part={folder}"


def read_state(spark: SparkSession, root: str) -> dict | None:
    """The newest state of an index, None where none was ever completed."""
    try:
        states = spark.read.text(f"{root}/state")
    except AnalysisException:
        return None
    newest = states.orderBy(F.get_json_object("value", "$.version").cast("long").desc()).first()
    state = json.loads(newest.value) if newest else None
    if state and state.get("layout") != LAYOUT:
        raise ValueError(f"the index at {root} has another layout: build it anew elsewhere")
    return state


def save_state(spark: SparkSession, root: str, state: dict) -> None:
    """One more state file; it appears when its write is committed, and the others stay."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("append").text(f"{root}/state")


def read_index(spark: SparkSession, root: str) -> TextIndex | None:
    state = read_state(spark, root)
    return None if state is None else TextIndex(spark, root, state)


def _new_part(version: int) -> str:
    """A folder that no other build uses, one that died included."""
    return f"v{version}-{uuid.uuid4().hex[:12]}"


def _save(df: DataFrame, path: str, key: list[str], small: bool) -> None:
    """A table of which each task sorts its own rows, so that statistics prune within each file; one task if small. Nothing is shuffled."""
    dealt = df.coalesce(1) if small else df
    dealt.sortWithinPartitions("field", *key).write.options(**PACKED).option("parquet.block.size", 16 << 20).partitionBy("field").parquet(path)


def _write_tables(root: str, folder: str, posts: DataFrame, books: DataFrame, lists: DataFrame, gone: DataFrame | None, small: bool, level: int) -> dict:
    """The tables of a part; its entry in a state."""
    spark = posts.sparkSession
    _save(posts.select("field", "term", "book_id", "dl", "positions"), _path(root, folder, "postings"), ["term", "book_id"], small)
    own = spark.read.schema(TABLES["postings"]).parquet(_path(root, folder, "postings"))
    counted = own.groupBy("field", "term").agg(F.count("*").alias("books"))
    (counted.coalesce(1) if small else counted).sortWithinPartitions("field", "term").write.partitionBy("field").parquet(_path(root, folder, "terms"))  # dealt by (field, term) already
    _save(lists, _path(root, folder, "grams"), ["gram"], small)
    (books.coalesce(1) if small else books).select("book_id", "update_id", "dl").write.parquet(_path(root, folder, "books"))
    part = {"folder": folder, "level": level, "gone": 0}
    if gone is not None:
        gone.coalesce(1).write.parquet(_path(root, folder, "gone"))
        part["gone"] = spark.read.schema(TABLES["gone"]).parquet(_path(root, folder, "gone")).count()
    size = spark.read.schema(TABLES["books"]).parquet(_path(root, folder, "books")).agg(F.count("*").alias("books"), F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    return part | size.asDict()


def write_part(source: DataFrame, root: str, folder: str, fields: list[str], gram_fields: list[str], gone: DataFrame | None = None, level: int = 0) -> dict:
    """The tables of some books as a part of root. The source is read once, and its texts are cut once, into a table of a row
    for each book, which the part's tables read."""
    cut = written(cut_books(source, fields, gram_fields), "cut", compression="zstd")
    letters = reduce(Column.__add__, [F.length(f"g{k}") for k in range(len(gram_fields))], F.lit(0))
    facts = cut.agg(F.coalesce(F.sum(F.col("dl") + letters), F.lit(0)).alias("rows"), F.count_if("cyrillic").alias("cyrillic")).first()
    whole = cut
    if facts.cyrillic:
        whole = cut.filter("not cyrillic").unionByName(written(with_stems(cut.filter("cyrillic"), len(fields)), "stemmed", compression="zstd"))
    return _write_tables(root, folder, forms(whole, fields), whole, gram_lists(cut, gram_fields), gone, facts.rows <= ONE_TASK_ROWS, level)


def _merged(spark: SparkSession, root: str, version: int, parts: list[dict], level: int) -> dict:
    """Consecutive parts as one, without what the later of them replace; it still replaces what they replace in earlier parts."""
    index = TextIndex(spark, root, {"parts": parts})
    gone = _read(spark, root, [p for p in parts if p["gone"]], "gone").distinct() if any(p["gone"] for p in parts) else None
    blocks = 1 + sum(p["books"] for p in parts) // LIST_BOOKS
    lists = index.grams.groupBy("field", "gram", F.pmod(F.hash("book_id"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list("book_id")).alias("books"))
    small = sum(p["dl"] for p in parts) <= ONE_TASK_ROWS
    return _write_tables(root, _new_part(version), index.postings, index.books, lists.select("field", "gram", "books"), gone, small, level)


def compact(spark: SparkSession, root: str, version: int, parts: list[dict]) -> list[dict]:
    """The parts after merging: as long as the last FANOUT are of one level they become one of the next; where replaced books
    outnumber those in force, all become one."""
    while len(parts) >= FANOUT and len({p["level"] for p in parts[-FANOUT:]}) == 1 and parts[-1]["level"] < FULL_LEVEL:
        parts = [*parts[:-FANOUT], _merged(spark, root, version, parts[-FANOUT:], parts[-1]["level"] + 1)]
    if len(parts) > 1 and 2 * sum(p["gone"] for p in parts) > sum(p["books"] for p in parts):
        whole = _merged(spark, root, version, parts, FULL_LEVEL)
        parts = [whole | {"gone": 0}]  # nothing is before it
    return parts


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def build_index(books: DataFrame, source: Callable[[int | None], DataFrame], root: str, fields: list[str], gram_fields: list[str], force: bool = False, files: list[str] | None = None) -> dict:
    """Bring the index at root up to date and return its state, with the action taken (skipped, incremental, full).

    books: book_id and update_id of all books; source: rows with book_id and the fields, of all books or those above a mark;
    files: the paths that they are read from, whose manifest is compared with that of the last build.
    """
    spark = books.sparkSession
    state, manifest = read_state(spark, root), file_manifest(spark, files) if files else None
    if state and manifest and not force and state.get("manifest") == manifest:
        return state | {"action": "skipped"}  # the same files: nothing needs to be counted
    step = decide(books, state, force, manifest).first()
    if step.action == "skipped":
        return state | {"action": "skipped"}
    version = state["version"] + 1 if state else 1
    more = step.action == "incremental"
    part = write_part(source(step.since), root, _new_part(version), fields, gram_fields, level=0 if more else FULL_LEVEL)
    before = state if more else {"parts": [], "indexed": 0, "forms": 0}
    new = {
        "version": version, "layout": LAYOUT, "books": step.books, "mark": step.mark, "manifest": manifest, "indexed_at": _now(), "streams": before.get("streams", {}),
        "indexed": before["indexed"] + part["n"], "forms": before["forms"] + part["dl"], "parts": compact(spark, root, version, [*before["parts"], part]), "action": step.action,
    }
    save_state(spark, root, new)
    return new


def newest(batch: DataFrame) -> DataFrame:
    """One row for each book: the largest update id (nulls are the oldest), of equal ones the same whatever the order of rows."""
    version = F.struct("update_id", F.xxhash64(*sorted(batch.columns)))
    return batch.groupBy("book_id").agg(F.max_by(F.struct(*batch.columns), version).alias("x")).select("x.*")


def deliver(batch: DataFrame, root: str, fields: list[str], gram_fields: list[str], stream: str | None = None, number: int | None = None) -> dict:
    """Add a batch of books (book_id, update_id, fields) to the index, and return its state.

    Of several versions of a book in the batch the newest counts. A book that the index holds is replaced, unless the index
    has a newer version; only the batch's own part is written, and the ids that it replaces. stream and number: whose batch
    it is; a batch that is replayed changes and writes nothing. Batches of a stream have growing numbers.
    """
    spark, index = batch.sparkSession, read_index(batch.sparkSession, root)
    state = index.state if index else {"version": 0, "layout": LAYOUT, "books": 0, "mark": None, "manifest": None, "indexed_at": None, "streams": {}, "indexed": 0, "forms": 0, "parts": []}
    if stream is not None and number is not None and number <= state["streams"].get(stream, -1):
        return state | {"action": "skipped"}
    rows = written(newest(batch), "delivery")
    facts = rows.agg(F.count("*").alias("books"), F.max("update_id").alias("mark")).first()
    state = state | {"version": state["version"] + 1, "action": "incremental", "streams": state["streams"] | ({stream: number} if stream is not None else {})}
    lost, gone = (0, 0, 0), None
    if index and facts.books:
        ids = rows.select("book_id", F.col("update_id").alias("new_id"))
        held = written(index.books.join(_within(ids, facts.books), "book_id").select("book_id", "dl", F.coalesce(F.col("new_id") < F.col("update_id"), F.col("new_id").isNull() & F.col("update_id").isNotNull()).alias("older")), "held")
        count = held.groupBy("older").agg(F.count("*").alias("books"), F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("dl")).collect()  # two rows at most
        for r in count:
            if r.older:
                rows = rows.join(_within(held.filter("older").select("book_id"), r.books), "book_id", "left_anti")
                facts = rows.agg(F.count("*").alias("books"), F.max("update_id").alias("mark")).first()
            else:
                gone, lost = held.filter("not older").select("book_id"), (r.books, r.n, r.dl)
    if facts.books:
        part = write_part(spread(rows), root, _new_part(state["version"]), fields, gram_fields, gone)
        state |= {"books": state["books"] + part["books"] - lost[0], "indexed": state["indexed"] + part["n"] - lost[1], "forms": state["forms"] + part["dl"] - lost[2]}
        state |= {"mark": max((x for x in (state["mark"], facts.mark) if x is not None), default=None), "manifest": None, "indexed_at": _now()}
        state["parts"] = compact(spark, root, state["version"], [*state["parts"], part])
    elif stream is None:
        return state | {"version": state["version"] - 1, "action": "skipped"}
    save_state(spark, root, state)
    return state
