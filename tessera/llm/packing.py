"""Best-fit packing of token sequences with exact-complement hashing.

Packing depends on lengths only, so it is planned on the histogram of lengths (at most `capacity` entries, whatever the
corpus). Sums of pairs and of triples of lengths are indexed by hash: a sum leads to a combination that gives it, replaced
as counts run out. For each length from the longest, the gap to the capacity is looked up among single lengths, pair sums
and triple sums; combinations that fill it exactly are consumed as often as the counts allow, and what is left is placed by
best fit, group by group. As triples may use up short lengths that long ones need, plans that index triples, pairs, single
lengths only or nothing are compared (see plan_packing), so where complements don't help, the result is plain best fit.

The plan is a table of runs - a length, a range of ranks, how many in a sequence, a first sequence and an offset. Its size
depends on the number of distinct lengths, not on rows: each step uses up a length or a group of open sequences, and a
sequence has at most 90 runs, as 90 different lengths have a sum of 4095. Pieces get their rank within their length from
counts of hashed cells, so one length may hold any share of rows.

Null text counts as empty (its end id alone). Repeated rows are packed once each. Null ids are packed too. Very long texts
are cut into pieces; an empty table gives none. Of the other columns of documents none is read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import read_spec
from .runtime import cut, plus, release, rows_per_task, ship

CAPACITY, END_ID = 4096, 1
#: Words kept encoded in a Python worker; the store is emptied when full.
CACHE, LONG_WORD = 200_000, 64
#: ASCII symbols, other than the apostrophe, between a small letter and the end of a part. (A class first: it is searched fastest.)
_SYMBOL = rb"[!-&(-/:-@[-`{-~]"
_STOP = re.compile(_SYMBOL + rb"(?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))" + _SYMBOL + rb"*(?=[ \n]|$)")
#: Small letters of ASCII and Latin-1 in UTF-8: no normaliser changes them, and no pre-tokenizer cuts between them.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Pieces in a cell of the rank count, on average over all lengths.
CELL_ROWS = 20_000


class WordCoder(dict):
    """Ids of texts by the tokenizers library, word by word; as a mapping, from words (UTF-8) to packed ids.

    The vocabulary's normaliser and pre-tokenizer never look across a space, so the ids of a text are those of its
    space-separated parts, one after another; each distinct part is encoded once, many in a call. Two changes of the text
    leave its ids alone and make fewer distinct parts: A-Z are lower-cased (as the normaliser does), and a space is put
    between a small letter and the ASCII symbols that end a part (where the pre-tokenizer cuts anyway). Texts that may hold
    a special token (`<|`) are left as they are.

    Parts of small Latin letters alone, nearly all of them, pass the normaliser unchanged as one piece. They are encoded
    many in one text by a tokenizer with the same model that only cuts at spaces; where the model marks the last token of
    a piece (`end_of_word_suffix`), its ids are cut at the marked tokens. Parts of over LONG_WORD bytes aren't stored.
    """

    def __init__(self, spec: bytes) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(spec)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.is_last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def words(self, text: str) -> list[bytes]:
        data = text.encode()
        if b"<|" not in data:
            data = _STOP.sub(rb" \g<0>", data.lower())
        return data.replace(b"\n", b" ").split(b" ")

    def _store(self, new: list[bytes]) -> None:
        """Encode and store words."""
        letters = [w for w in new if (w.isalpha() and w.islower()) or _LETTERS.fullmatch(w)]  # the first test is the cheaper
        for at in range(0, len(letters), 10_000):
            some = letters[at : at + 10_000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.is_last[ids]) + 1)
            if len(ends) == len(some):
                packed = ids.tobytes()
                self.update(zip(some, map(packed.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        rest = [w for w in new if w not in self]
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self[word] = array("I", found.ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        parts = [self.words(t) for t in texts]
        new = list(set().union(*parts) - self.keys())
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(set().union(*parts))
        self._store(new)
        done = [b"".join(map(self.__getitem__, ws)) for ws in parts]
        for word in new:
            if len(word) > LONG_WORD:
                del self[word]
        return done


_CODERS: dict[int, WordCoder] = {}


def _encoding(sent, names: list[str], text: str, ids: str, end_id: int, kept: list[str]):
    """Over batches with the columns names: the kept ones, and ids of the text with the end id after them."""

    def run(batches):
        spec, end = sent.value, int(end_id).to_bytes(4, "little")
        if (key := hash(spec)) not in _CODERS:
            release()
            _CODERS[key] = WordCoder(spec)
            release()
        c = _CODERS[key]
        for whole in batches:
            for batch in rows_per_task(whole, text, 2 << 20):
                packed = [x + end for x in c.encode_all([t or "" for t in batch.column(names.index(text)).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(packed, pa.binary())], [*kept, ids])

    return run


PIECE_COLUMNS = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}


def _cutting(names: list[str], ids: str, capacity: int, kept: list[str]):
    """Over batches with the columns names: a row for each piece, with the kept columns and PIECE_COLUMNS."""

    def run(batches):
        for batch in batches:
            rows, at, out = [], [], []
            for i, x in enumerate(batch.column(names.index(ids)).to_pylist()):
                for k in range(0, max(len(x) // 4, 1), capacity):
                    rows.append(i)
                    at.append(k)
                    out.append(x[4 * k : 4 * (k + capacity)])
            taken = [pa.array(out, pa.binary()) if n == ids else batch.column(names.index(n)).take(pa.array(rows, pa.int32())) for n in kept]
            new = [pa.array([k // capacity for k in at], pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([zlib.crc32(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*taken, *new], [*kept, *PIECE_COLUMNS])

    return run


def tokenize(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", end_id: int = END_ID) -> DataFrame:
    """docs with packed little-endian ids of the whole text and the end id after them."""
    ship(docs.sparkSession)
    docs = docs.drop(ids)
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    return docs.mapInArrow(_encoding(sent, docs.columns, text, ids, end_id, docs.columns), plus(docs, **{ids: "binary"}))


def cut_pieces(docs: DataFrame, ids: str = "ids", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of at most capacity tokens: the input's columns with ids cut, and piece, start, length, ids_crc32.

    Input columns of these names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*PIECE_COLUMNS)
    return docs.mapInArrow(_cutting(docs.columns, ids, capacity, docs.columns), plus(docs, **PIECE_COLUMNS))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id and PIECE_COLUMNS of each piece of the documents, without ids: tokenize and cut_pieces in one Python worker."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    encode, cut_up = _encoding(sent, docs.columns, "text", "ids", end_id, ["doc_id"]), _cutting(["doc_id", "ids"], "ids", capacity, ["doc_id"])
    return docs.mapInArrow(lambda batches: cut_up(encode(batches)), plus(docs.select("doc_id"), **PIECE_COLUMNS))


class Complements:
    """Indexes of the sums of available lengths: single ones (their counts), pairs and triples.

    pair[s] and triple[s] hold the larger or largest length of a combination with sum s, 0 for none. Counts only fall, so
    an entry is looked for again where its lengths have run out, among smaller largest lengths, and a sum without a
    combination never gets one.
    """

    def __init__(self, left: np.ndarray, most: int) -> None:
        n = len(left)
        self.left, self.most = left, most
        self.pair, self.triple, self.twos = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a in np.flatnonzero(left[: n - 1] > 0) if most > 1 else []:  # the largest a of each sum is written last
            b = np.flatnonzero(left[1 : min(a, n - 1 - a) + 1]) + 1
            b = b if left[a] > 1 else b[b < a]
            self.pair[a + b] = a
        for a in np.flatnonzero(left[: n - 1] > 0) if most > 2 else []:
            held = np.flatnonzero(self.pair[: n - a])
            self.triple[held + a] = a

    def _has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _two(self, total: int) -> tuple[int, int] | None:
        """Available a >= b with this sum, the largest a."""
        a = int(self.pair[total])
        if a and self._has(a, total - a):
            return a, total - a
        if a:
            low = (total + 1) // 2
            both = (self.left[low : a + 1] > 0) & (self.left[total - a : total - low + 1][::-1] > 0)
            if total % 2 == 0 and self.left[low] < 2:
                both[0] = False
            found = np.flatnonzero(both)
            self.pair[total] = a = low + int(found[-1]) if found.size else 0
        return (a, total - a) if a else None

    def _three(self, total: int) -> tuple[int, int, int] | None:
        """Available lengths with this sum, from the largest first one for which two more are indexed."""
        while a := int(self.triple[total]):
            if self.left[a] and (two := self._two(total - a)):
                if self._has(a, *two):
                    return a, *two
                self.left[a] -= 1  # a pair without a, for this lookup only
                kept, two = self.pair[total - a], self._two(total - a)
                self.left[a] += 1
                self.pair[total - a] = kept
                if two:
                    return a, *two
            below = np.flatnonzero((self.left[1:a] > 0) & (self.pair[total - a + 1 : total][::-1] > 0))
            self.triple[total] = 1 + below[-1] if below.size else 0
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap."""
        if self.most and self.left[gap]:
            return (gap,)
        return self._two(gap) or self._three(gap)


Runs = tuple[tuple[int, int], ...]  # (length, how many) in a sequence, in order


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences needed at least: by the sum of lengths, and by lengths of which no two fit together."""
    return max(-(-sum(k * n for k, n in histogram.items()) // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Runs, int]], int]:
    """(runs in a sequence, number of such sequences) for counts of lengths from 1 to capacity, and the largest complement used.

    Plans with complements of up to three, two, one and no further lengths are compared: the first that meets the lower
    bound is taken, else the one with the fewest sequences, the larger complement on a tie.
    """
    best: tuple[int, list[tuple[Runs, int]], int] | None = None
    for most in (3, 2, 1, 0):
        plan = _plan(histogram, capacity, most)
        total = sum(n for _, n in plan)
        if best is None or total < best[0]:
            best = (total, plan, most)
        if best[0] <= lower_bound(histogram, capacity):
            break
    return best[1:]


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[Runs, int]]:
    """One plan, with exact complements of up to `most` lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[Runs, int]] = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    index = Complements(left, most)
    open_by_gap: dict[int, list[tuple[Runs, int]]] = defaultdict(list)
    gaps: list[int] = []  # sorted

    def put(runs: Runs, n: int) -> None:
        gap = capacity - sum(length * k for length, k in runs)
        if gap == 0:
            done.append((runs, n))
            return
        if not open_by_gap[gap]:
            bisect.insort(gaps, gap)
        open_by_gap[gap].append((runs, n))

    for length in range(capacity - 1, 0, -1):
        while left[length]:
            n = int(left[length])
            # Exact complements of a sequence that this length begins.
            left[length] -= 1
            rest = index.filling(capacity - length)
            left[length] += 1
            if rest:
                need = Counter((length, *rest))
                times = min(int(left[x]) // k for x, k in need.items())
                for x, k in need.items():
                    left[x] -= k * times
                put(tuple(need.items()), times)
                continue
            # Best fit into the open sequences with the smallest sufficient gap, else new ones.
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                per, rest_n = divmod(n, each)
                left[length] = 0
                if per:
                    put(((length, each),), per)
                if rest_n:
                    put(((length, rest_n),), 1)
                continue
            gap = gaps[at]
            runs, m = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps.pop(at)
            fit = min(gap // length, n)  # as many of this length as a sequence takes
            used = min(m, n // fit)
            left[length] -= used * fit
            put((*runs, (length, fit)), used)
            if m > used:
                put(runs, m - used)
    for group in open_by_gap.values():
        done.extend(group)
    return done


def slots(plan: list[tuple[Runs, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many in a sequence, first sequence, offset) for each run: ranks from there on fill the sequences from there on."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for runs, n in plan:
        offset = 0
        for length, k in runs:
            out.append((length, used[length], k, first, offset))
            used[length] += n * k
            offset += length * k
        first += n
    return sorted(out)


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (columns length, doc_id, piece; already materialised) with sequence_id and offset, gapless from 0 in each sequence."""
    ship(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    cells = max(1, -(-pieces.count() // CELL_ROWS))
    cell, base, rank_of = (_fresh(name, pieces.columns) for name in ("cell", "base", "rank"))
    keyed = pieces.withColumn(cell, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    counted = keyed.groupBy("length", cell).agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity entries at most
    table = slots(plan_packing(histogram, capacity)[0])
    before = Window.partitionBy("length").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("length", cell).orderBy("doc_id", "piece")
    ranked = keyed.withColumn(rank_of, F.row_number().over(within) - 1).join(bases, ["length", cell])
    ranked = ranked.select(*pieces.columns, (F.col(base) + F.col(rank_of)).alias(rank_of))
    sent, names = pieces.sparkSession.sparkContext.broadcast(np.array(table, np.int64).reshape(-1, 5)), ranked.columns  # bounded by the distinct lengths
    kept = pieces.columns

    def run(batches):
        t = sent.value
        keys = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            rank = batch.column(names.index(rank_of)).to_numpy(zero_copy_only=False)
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            into = rank - t[at, 1]
            new = [pa.array(t[at, 3] + into // t[at, 2]), pa.array(t[at, 4] + into % t[at, 2] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *new], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, plus(pieces, sequence_id="long", offset="long"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset for documents (doc_id, text), one row for each piece."""
    return place(cut(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their places: of all rows, null ids, null texts and repeated rows included; other columns are not read."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
