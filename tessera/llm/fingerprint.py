"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of a symbol become one symbol; deterministic coin tossing then reduces each symbol
to a label below 6 that differs from its neighbour's and depends on a few symbols to its left only; a phrase starts at
every local maximum of the labels and is named by a hash of its symbols; names are the symbols of the next level. Equal
substrings are therefore cut and named alike in their interior, wherever they stand. A fingerprint holds the KEPT
smallest of the distinct names of LEVELS, as hexadecimal; the likeness of two is the share of common names among the
smallest of both, which estimates the Jaccard similarity of the name sets.

Null text counts as empty. The fingerprint of an empty text is ''; two empty ones have likeness 1, one has 0. Equal texts
have equal fingerprints, so ties can't differ. Very long texts are parsed whole, each at once; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import rows_per_task, ship

LEVELS, KEPT = (2, 3), 64
#: Documents in a bucket of consecutive ids, on average, and the most buckets: the driver holds a small row of each.
BUCKET_ROWS, MAX_BUCKETS = 4096, 1 << 16
#: Sampled rows (a key and a hash each) that the bounds of a bucket are set by, and buckets in a task.
SAMPLED, BUCKETS_IN_TASK = 24, 8
#: Characters parsed at once.
CHUNK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(4))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[0]
    return x ^ (x >> np.uint64(31))


def _toss_table() -> np.ndarray:
    """The label of y after x for labels below 128: twice the lowest bit at which they differ, plus that bit of y."""
    x, y = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = x ^ y
    k = np.bitwise_count((differ & -differ) - 1)
    return np.where(differ > 0, 2 * k + ((y >> np.minimum(k, 7)) & 1), 0).astype(np.uint8).ravel()


_TOSS = _toss_table()


def _parse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of several non-empty sequences, one after another, and where each sequence's names start."""
    n = len(x)
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(x[1:], x[:-1], out=head[1:])
    head[starts] = True
    at = np.flatnonzero(head)
    runs = np.diff(at, append=n)
    y = x[at]
    long = runs > 1
    y[long] = _mix(y[long] + runs[long].astype(np.uint64) * _MIX[0])
    starts = np.searchsorted(at, starts)

    left = np.empty_like(y)
    left[1:] = y[:-1]
    left[starts] = y[starts] ^ np.uint64(1)
    differ = y ^ left
    low = differ & (~differ + np.uint64(1))
    k = np.bitwise_count(low - np.uint64(1))
    label = (k << 1) | ((y & low) != 0)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[starts] = label[starts] ^ 1
        label = _TOSS[before.astype(np.uint16) << 7 | label]
    up = np.ones(len(y), bool)
    up[:-1] = label[:-1] > label[1:]
    up[starts[1:] - 1] = up[-1] = False  # a sequence's last symbol starts no phrase
    up[1:] &= label[1:] > label[:-1]
    up[starts] = True
    begin = np.flatnonzero(up)
    place = np.arange(len(y)) - np.repeat(begin, np.diff(begin, append=len(y)))
    names = _mix(np.add.reduceat(_mix(y + _MIX[0]) * _PLACE[np.minimum(place, 63)], begin))
    return names, np.searchsorted(begin, starts)


def _names(texts: list[str]) -> list[np.ndarray]:
    """The distinct names of each non-empty text, sorted, big-endian, so that their hexadecimal forms sort alike."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    found = []
    for level in range(1, max(LEVELS) + 1):
        x, starts = _parse(x, starts)
        if level in LEVELS:
            found.append(np.split((x >> np.uint64(32)).astype(np.uint32), starts[1:]))
    return [np.unique(np.concatenate(parts)).astype(">u4") for parts in zip(*found, strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    out, held, size = [""] * len(texts), [], 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size + len(t) > CHUNK):
            for j, names in zip(held, _names([texts[j] for j in held]), strict=True):
                out[j] = names[:KEPT].tobytes().hex()
            held, size = [], 0
        if t:
            held.append(i)
            size += len(t)
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    smallest = sorted(x | y)[:KEPT]
    return sum(z in x and z in y for z in smallest) / len(smallest)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """A narrow pandas function over any table: docs with the fingerprint of a text column."""
    ship(docs.sparkSession)
    named = F.pandas_udf(lambda s: pd.Series(fingerprints([t or "" for t in s])), "string")
    return docs.withColumn(out, named(text))


def _bounds(key: np.ndarray, mix: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that part sampled ones into about equal shares, ascending."""
    order = np.lexsort((mix, key))
    at = order[np.unique(np.arange(1, buckets) * len(order) // buckets)] if len(order) else order
    return key[at], mix[at]


def _bucket_of(key: np.ndarray, mix: np.ndarray, bound_key: np.ndarray, bound_mix: np.ndarray) -> np.ndarray:
    """How many bounds are not above each pair."""
    low, high = np.searchsorted(bound_key, key), np.searchsorted(bound_key, key, side="right")
    tied = np.flatnonzero(low < high)
    for k in np.unique(key[tied]):
        same = tied[key[tied] == k]
        a, b = low[same[0]], high[same[0]]
        low[same] = a + np.searchsorted(bound_mix[a:b], mix[same], side="right")
    return low


def in_pairs(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) fingerprinted with the next by descending id, and with a text edited from both.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text is
    the text with its last floor(n/2) code points replaced by the first as many of the next document, which for the last
    is the first; a single document follows itself. Null ids come last; rows with equal ids follow by a hash of the text.

    Documents are dealt to buckets of consecutive (id, hash of the text), and a copy of each bucket's first goes to the end
    of the bucket before: texts are shuffled once, and one row of a bucket twice. The bounds come from a sample, so null
    or repeated ids are split too; only rows with the same id and text stay together. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("mix", F.xxhash64("text"))
    places = keyed.select("key", "mix")
    rows = places.count()
    buckets = min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS))
    sample = places.sample(min(1.0, SAMPLED * buckets / max(1, rows)), seed=4).toArrow() if buckets > 1 else None  # SAMPLED * MAX_BUCKETS rows of 16 bytes at most
    bounds = _bounds(sample["key"].to_numpy(), sample["mix"].to_numpy(), buckets) if sample else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    bucket = F.pandas_udf(lambda k, m: pd.Series(_bucket_of(k.to_numpy(), m.to_numpy(), *bounds)), "long")
    tops = places.groupBy(bucket("key", "mix").alias("bucket")).agg(F.max(F.struct("key", "mix")).alias("top")).collect()  # a row of each bucket
    firsts = sorted((r.bucket, r.top.key, r.top.mix) for r in tops)
    # Ids fall, so a bucket's first comes after the last of the bucket above it; the highest's after the lowest's.
    copied = {(key, mix): firsts[(i + 1) % len(firsts)][0] for i, (_, key, mix) in enumerate(firsts)}
    copy_to = F.pandas_udf(lambda k, m: pd.Series([copied.get(x) for x in zip(k, m, strict=True)], dtype="Int64"), "long")
    dealt = keyed.select("*", bucket("key", "mix").alias("own"), copy_to("key", "mix").alias("other"))
    both = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy")), F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("bucket"), F.lit(True).alias("copy")))))
    rows = dealt.select("doc_id", "text", "key", "mix", F.explode(both).alias("at")).select("doc_id", "text", "at.bucket", "at.copy", "key", "mix")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS_IN_TASK)
    ordered = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "copy", F.desc("key"), F.desc("mix")).select("doc_id", "text", "copy")

    def run(batches):
        last = None
        for whole in batches:
            for batch in rows_per_task(whole, "text", 4 << 20):
                texts = batch.column(1).to_pylist()
                rows = list(zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), fingerprints(texts), strict=True))
                seen = rows if last is None else [last, *rows]
                last = rows[-1]
                pairs = [(a, b) for a, b in itertools.pairwise(seen) if not a[2]]
                edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
                prints = fingerprints(edited)
                columns = (
                    ([a[0] for a, _ in pairs], pa.int64()),
                    ([len(a[1]) for a, _ in pairs], pa.int64()),
                    ([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    ([a[3] for a, _ in pairs], pa.string()),
                    (prints, pa.string()),
                    ([likeness(a[3], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                    ([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                )
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
