"""Importance resampling towards a target's n-gram distribution, by bucketed log ratios and deterministic Gumbel noise.

Words are runs of digits, letters a-z (A-Z are lowered) and characters beyond U+007F; features are all runs of one or two
consecutive words of a text, repeats counted. Within a batch, n-grams are interned in an open-addressed NumPy table: keys
are xxhash64 of their bytes, and equal keys are verified byte by byte; a slot holds the n-gram's bucket and its count. The
counts of a batch go to the bucket totals, and in the second pass the occurrences' slot ids gather the gains.

Null and empty texts have no features, weight 0, and are never drawn. A null id stands as no text in the noise, and comes
first among ties. Repeated rows are repeated documents. Very long texts are worked through in runs of words, so memory
follows the batch. An empty table gives an empty result, an empty target equal gains. Only the columns named are read, so
others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, rows_per_task, ship
from .sql import crc32 as crc32_sql

BUCKETS, LEAST_WORDS, DRAW_PERCENT, SEED = 10_000, 20, 25, 7
#: Words of one run, and bytes of text of one batch: they bound the arrays of a task.
RUN_WORDS, BATCH_BYTES = 1 << 17, 2 << 20
#: The primes of xxhash64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: N-grams of as many bytes and more take the other branch of xxhash64 and are hashed one by one.
LONG = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


class Words(NamedTuple):
    """The words of some texts, each followed by one space, so that a run of words is a slice."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\x00".join([*raw, b""]), np.uint8)
    low = _LOWER[joined]
    inside = _IS_WORD[low]
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    kept = inside | before  # a word's bytes and the separator behind it
    ends_at = before & ~inside
    doc = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])[ends_at]
    low[ends_at] = 32
    plain = low[kept]
    end = np.flatnonzero(plain == 32)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    return Words(plain.tobytes(), start, end, doc)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class Slices:
    """Slices of a buffer, read 8 bytes at a time."""

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray) -> None:
        padded = data + bytes(LONG + 8)
        self.data, self.start, self.size = data, start, size
        self.lane = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        self.half = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
        self.byte = np.frombuffer(padded, np.uint8)

    def hashes(self) -> np.ndarray:
        """xxhash64 of each slice, seed 0; the short ones all at once."""
        h = P5 + self.size.astype(np.uint64)
        at, left = self.start.copy(), self.size.copy()
        with np.errstate(over="ignore"):
            for _ in range(LONG // 8 - 1):
                if not len(i := np.flatnonzero(left >= 8)):
                    break
                x = h[i] ^ (_rotl(self.lane[at[i]] * P2, 31) * P1)
                h[i] = _rotl(x, 27) * P1 + P4
                at[i] += 8
                left[i] -= 8
            i = np.flatnonzero(left >= 4)
            h[i] = _rotl(h[i] ^ (self.half[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
            at[i] += 4
            left[i] -= 4
            for _ in range(3):
                i = np.flatnonzero(left > 0)
                h[i] = _rotl(h[i] ^ (self.byte[at[i]].astype(np.uint64) * P5), 11) * P1
                at[i] += 1
                left[i] -= 1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
        for i in np.flatnonzero(self.size >= LONG):
            s = self.start[i]
            h[i] = xxhash.xxh64_intdigest(self.data[s : s + self.size[i]])
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether slices a and b (index arrays) hold the same bytes."""
        same = self.size[a] == self.size[b]
        for k in range(0, LONG, 8):
            i = np.flatnonzero(same & (self.size[a] > k))
            if not len(i):
                return same
            x = self.lane[self.start[a[i]] + k] ^ self.lane[self.start[b[i]] + k]
            rest = self.size[a[i]] - k
            same[i] = np.where(rest >= 8, x, x & _TAIL[np.minimum(rest, 7)]) == 0
        for i in np.flatnonzero(same & (self.size[a] > LONG)):
            s, t, n = self.start[a[i]], self.start[b[i]], self.size[a[i]]
            same[i] = self.data[s : s + n] == self.data[t : t + n]
        return same


class Table:
    """Open-addressed table of n-grams: key, owner (one occurrence), bucket and count in parallel slots; linear probing."""

    def __init__(self, slices: Slices, keys: np.ndarray | None = None, buckets: int = BUCKETS) -> None:
        n = len(slices.start)
        bits = max(4, (2 * n - 1).bit_length() if n else 4)
        self.owner = np.full(1 << bits, -1, np.int64)
        keys = slices.hashes() if keys is None else keys
        mask = np.int64((1 << bits) - 1)
        at = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            where = at[todo]
            free = self.owner[where] < 0
            self.owner[where[free]] = todo[free]  # of several that claim a slot one stays
            held = self.owner[where]
            mine = keys[held] == keys[todo]
            mine[mine] = slices.equal(todo[mine], held[mine])
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & mask
        self.slot_of = at  # of each occurrence
        used = np.flatnonzero(self.owner >= 0)
        first = self.owner[used]
        self.bucket = np.zeros(1 << bits, np.int64)
        starts = slices.start[first]
        self.bucket[used] = [crc32(slices.data[a:b]) % buckets for a, b in zip(starts.tolist(), (starts + slices.size[first]).tolist(), strict=True)]
        self.count = np.bincount(at, minlength=1 << bits)


def runs(words: Words, most: int = RUN_WORDS) -> Iterator[tuple[Table, np.ndarray]]:
    """The table of the n-grams of each run of at most `most` words, and the text that each occurrence belongs to."""
    n = len(words.start)
    for a in range(0, n, most):
        b = min(n, a + most)
        one = np.arange(a, b)
        two = one[: b - a - (b == n)]
        two = two[words.doc[two] == words.doc[two + 1]]
        start = np.concatenate([words.start[one], words.start[two]])
        end = np.concatenate([words.end[one], words.end[two + 1]])
        yield Table(Slices(words.data, start, end - start)), np.concatenate([words.doc[one], words.doc[two]])


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket and n: how many features of all texts fall into each bucket; each task sends one row a bucket at most."""
    ship(texts.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in rows_per_task(whole, text, BATCH_BYTES):
                for table, _ in runs(words_of(batch.column(0).to_pylist())):
                    total += np.bincount(table.bucket, table.count, BUCKETS).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from counts (bucket, n) of at most BUCKETS rows each: 1000 times the smoothed log ratio, floored."""
    s, t = ([0] * BUCKETS for _ in range(2))
    for counts, frame in ((s, source), (t, target)):
        for r in frame.collect():
            counts[r.bucket] = r.n
    S, T = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((y + 1) * S / ((x + 1) * T))) for x, y in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain of its features; 0 without any) of every document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for whole in batches:
            for batch in rows_per_task(whole, text, BATCH_BYTES):
                n, words = batch.num_rows, words_of(batch.column(1).to_pylist())
                features, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for table, doc in runs(words):
                    features += np.bincount(doc, minlength=n)
                    np.add.at(total, doc, gain[table.bucket][table.slot_of])
                n_words = np.bincount(words.doc, minlength=n) if len(words.doc) else np.zeros(n, np.int64)
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, features, weight))], [doc_id, "n_words", "n_features", "weight"])

    kept = docs.select(doc_id, text)
    return kept.mapInArrow(run, f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = DRAW_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id") -> DataFrame:
    """weighed with score (weight and Gumbel noise of the id) and rank: 1, 2, 3... among the drawn, else null.

    The ranks come from a range partitioning by score: each partition is sorted by itself, and only the partitions' sizes
    are brought to the driver.
    """
    spark = weighed.sparkSession
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc(doc_id)]
    placed = cut(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    most = percent * sum(n for _, n in sizes) // 100
    begins, before = [], 0
    for p, n in sizes:
        begins.append((p, before))
        before += n
    ranked = placed.join(F.broadcast(spark.createDataFrame(begins, "part long, before long")), part == F.col("part"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    columns = [*weighed.columns, "score"]
    drawn = ranked.select(*columns, F.when(rank <= most, rank).alias("rank"))
    return drawn.unionByName(scored.filter(F.coalesce(F.col("n_words") < least_words, F.lit(True))).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", percent: int = DRAW_PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return draw(weigh(docs, gain, doc_id, text), percent, doc_id=doc_id)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = rf"""
with texts as (select 'd' as side, row_number() over () as r, doc_id, text from documents union all select 't', row_number() over (), null, text from benchmark),
w as (select side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
f as (select side, r, unnest(w) as x from w union all select side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w where len(w) > 1),
c as materialized (select side, r, x, count(*) as n from f group by all), names as materialized (select distinct x from c), {crc32_sql("names")},
b as materialized (select x, crc % 10000 as bucket from crc),
k as (select bucket, sum(case when side = 'd' then n else 0 end) as s, sum(case when side = 't' then n else 0 end) as t from c join b using (x) group by 1),
z as (select coalesce(sum(s), 0)::double + 10000 as zs, coalesce(sum(t), 0)::double + 10000 as zt from k),
g as (select bucket, floor(1000 * ln(((t + 1)::double * zs) / ((s + 1)::double * zt)))::bigint as gain from k, z),
q as (select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from c join b using (x) join g using (bucket) where side = 'd' group by 1),
h as (select doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::bigint as h from w left join q using (r) where side = 'd'),
e as (select doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
o as (select *, case when words >= 20 then row_number() over (partition by words >= 20 order by score desc, doc_id nulls first) end as place, 25 * count(*) filter (words >= 20) over () // 100 as most from e)
select doc_id, n_features::bigint as n_features, weight, score, case when place <= most then place end::bigint as rank from o"""
