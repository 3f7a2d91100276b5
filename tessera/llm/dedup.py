"""Near-duplicate documents: MinHash banding with sequential Bayesian verification, exact links and components.

A document is the set of its distinct shingles of `width` words (words: runs of characters other than space and
U+0009..U+000D, A-Z lower-cased); with fewer words, the whole sequence is one shingle; null text and text without words
has no shingle and no link. Two documents are linked where 100 * |A and B| >= percent * |A or B|. Sets are held as
64-bit hashes of shingles, signatures as 120 minimum hashes, banded, of which a byte each is kept (equal hashes have
equal bytes, so no link is lost by that).

1. Equal sets form one class, whose smallest id stands for it.
2. Within a bucket, classes that share a band, pairs not connected yet are compared by batches of their signatures and
   dropped once the posterior probability of a link (uniform prior, binomial matches) falls below MISS. What is left is
   reported as a spanning forest: fewer links than members. A bucket above BUCKET rows isn't compared but linked as a star,
   so all of it goes on to the verification: that costs its rows, not their square.
3. The forests' components are groups, which hold every linked pair. A group of up to BLOCK classes (and BLOCK_SHINGLES
   shingles) is settled in one task on full sets, pairs that are not connected yet only; survivors are verified exactly.
4. A larger group is first dealt twice into random blocks, which connects nearly all that is linked at one copy of a set a
   round. Then blocks of classes that are still apart are compared in pairs; blocks of one component never meet. A group
   that this would copy more than CELLS times (a passage that very many documents share) is divided first: two linked sets share
   one of their rarest shingles, so classes are grouped anew by steps 2 and 3 with these in place of bands. The order of
   rarity is a table of COUNTS counters; what they hold steers the cost alone.
5. Links are joined into components; all documents of a class get its component.

Nulls: a null id links with nothing; its component_id is null and it is kept. Rows that repeat an id are one document and
each is returned with its own n_shingles; of different texts of one id the one with most shingles (ties: by a hash)
counts. Very long texts only make larger sets, which count for the blocks' size. An empty table gives none. Only the id and
the text are read, so other columns can't clash. No cap on candidates, bucket sizes or links.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import bounded_broadcast, cut, cut_narrow, join_sized, release, rows_per_task, ship

WIDTH, PERCENT = 5, 80
HASHES, BATCH = 120, 30
#: Largest probability of missing a linked pair, by banding and by each pruning step.
MISS = 1e-6
#: Classes, and shingles on average, of a group that one task settles; rows of a bucket that one task compares.
BLOCK, BLOCK_SHINGLES, BUCKET = 128, 4_000_000, 1024
#: Copies of a text (on average) that pairs of blocks may cost before a group is divided by rare shingles.
CELLS = 8
#: Counters of shingles by which rarity is judged, a power of two: 1 MB with every task.
COUNTS = 1 << 18
CACHE = 250_000


def band_rows(percent: int) -> int:
    """The most rows in a band (of HASHES in all) at which a pair at the threshold shares no band with probability MISS at most."""
    fits = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) <= MISS]
    return max(fits, default=1)


def prune_below(percent: int) -> list[int]:
    """For each signature batch, the fewest matches so far at which P(similarity >= threshold) is MISS or more."""
    s, out = percent / 100, []
    for k in range(BATCH, HASHES + 1, BATCH):
        # Beta(m + 1, k - m + 1) above s has the probability of at most m successes among k + 1 trials of chance s.
        below, m = 0.0, 0
        while m <= k:
            below += math.exp(math.lgamma(k + 2) - math.lgamma(m + 1) - math.lgamma(k + 2 - m) + m * math.log(s) + (k + 1 - m) * math.log1p(-s)) if s < 1 else float(m > k)
            if below >= MISS:
                break
            m += 1
        out.append(min(m, k))
    return out


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
_RNG = np.random.Generator(np.random.PCG64(20))
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * _STEP
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes of a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 256):
        np.minimum(low, (shingle_set[None, at : at + 256] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of each signature's bands, which tell the bands apart."""
    parts = sigs.reshape(len(sigs), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = (keys ^ parts[:, :, k]) * _STEP
        keys ^= keys >> np.uint64(31)
    return keys


def sign(docs: DataFrame, width: int, rows: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, bands (hashes) and sig (a byte of each minimum hash); the last three null for an empty set."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in (part for whole in batches for part in rows_per_task(whole, "text")):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s) if len(s) else None for s in sets]
            bands = [None if s is None else band_keys(s[None], rows)[0].view(np.int64) for s in sigs]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in sigs], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "set_key", "bands", "sig"])
        _WORDS.clear()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<bigint>, sig binary")


def surviving(x: np.ndarray, y: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows outlast the pruning, batch by batch, and their numbers of matches."""
    at, same = np.arange(max(len(x), len(y))), np.zeros(max(len(x), len(y)), np.int64)
    x, y = np.broadcast_to(x, (len(at), HASHES)), np.broadcast_to(y, (len(at), HASHES))
    for step, fewest in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        same = same + (x[at, part] == y[at, part]).sum(axis=1)
        at, same = at[same >= fewest], same[same >= fewest]
    return at, same


def forest(ids: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, sigs: np.ndarray, percent: int, confirm: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among some documents and isn't by their labels, fewer than documents.

    With two sides, only pairs across are compared. confirm decides on two positions; without it the signatures do.
    """
    least, across = prune_below(percent), side.min() != side.max()
    label, links = np.unique(label, return_inverse=True)[1], []
    for p in range(len(ids) - 1):
        near = label[p + 1 :] != label[p]
        if across:
            near &= side[p + 1 :] != side[p]
        q = np.flatnonzero(near) + p + 1
        q = q[np.minimum(size[q], size[p]) * 100 >= percent * np.maximum(size[q], size[p])]
        if not q.size:
            continue
        at, same = surviving(sigs[q], sigs[p : p + 1], least)
        for x in q[at[np.argsort(-same, kind="stable")]]:
            if label[x] != label[p] and (confirm is None or confirm(p, int(x))):
                links.append((int(ids[p]), int(ids[x])))
                low, high = sorted((label[p], label[x]))
                label[label == high] = low
    return links


def settle(ids: np.ndarray, side: np.ndarray, label: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """forest, verified on full sets."""
    order = np.argsort(ids, kind="stable")
    sets, size = [sets[i] for i in order], np.array([len(sets[i]) for i in order])
    dense, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate([[0], np.cumsum(size)])
    marked, held = np.zeros(int(dense.max(initial=0)) + 1, bool), [-1]

    def confirm(p: int, x: int) -> bool:
        if held[0] != p:
            marked[:] = False
            marked[dense[starts[p] : starts[p + 1]]] = True
            held[0] = p
        both = int(np.count_nonzero(marked[dense[starts[x] : starts[x + 1]]]))
        return 100 * both >= percent * (int(size[p]) + int(size[x]) - both)

    return forest(ids[order], side[order], label[order], size, sigs[order], percent, confirm)


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of each node to the smallest one that the given links connect it with: never more than these."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return sorted((x, top(x)) for x in list(root) if top(x) != x)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _settle_groups(percent: int, width: int):
    """Over rows group, part, side, doc_id, label, sig and text, sorted by the first two: what verified links connect in each part of a group, as stars."""

    def flush(held):
        best: dict[int, tuple] = {}  # of one id's texts, the one that counts
        for side, doc_id, label, sig, text in held:
            s = shingles(text, width)
            key = (len(s), xxhash.xxh3_128_digest(s.tobytes()))
            if doc_id not in best or best[doc_id][0] < key:
                best[doc_id] = (key, side, label, sig, s)
        ids = list(best)
        column = lambda i: [best[x][i] for x in ids]
        return settle(np.array(ids, np.int64), np.array(column(1)), np.array(column(2), np.int64), np.array([np.frombuffer(x, np.uint8) for x in column(3)]), column(4), percent)

    def run(batches):
        def stream():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        links: list[tuple[int, int]] = []
        for _, part in groupby(stream(), key=lambda r: r[:2]):
            links += flush([r[2:] for r in part])
            if len(links) > 20_000:
                yield _links(stars(links))
                links = []
        yield _links(stars(links))
        _WORDS.clear()
        release()

    return run


def _link_buckets(percent: int):
    """Over rows key, doc_id, n_shingles and sig, sorted by the first two: what the buckets' forests by signatures connect, as stars."""

    def run(batches):
        least, rest = prune_below(percent), None
        for batch in chain(batches, [None]):
            if batch is None and rest is None:
                break
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                new.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES))
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            key, ids, size, sigs = rest
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(key))
            if batch is not None and len(starts):  # the last bucket may go on
                rest = [x[starts[-1] :] for x in rest]
                starts, ends = starts[:-1], ends[:-1]
            two = starts[ends - starts == 2]
            two = two[(np.minimum(size[two], size[two + 1]) * 100 >= percent * np.maximum(size[two], size[two + 1])) & (ids[two] != ids[two + 1])]
            found = two[surviving(sigs[two], sigs[two + 1], least)[0]] if len(two) else two
            links = list(zip(ids[found].tolist(), ids[found + 1].tolist(), strict=True))
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                links += forest(ids[s:e], np.zeros(e - s), ids[s:e], size[s:e], sigs[s:e], percent)
            yield _links(stars(links))
            if batch is None:
                break
        release()

    return run


def shared_links(rows: DataFrame, percent: int, bucket: int, labelled: bool = False) -> DataFrame:
    """Pairs (a, b) that connect, in each bucket, what the signatures don't rule out. rows: doc_id, n_shingles, bands, sig (written).

    Buckets of up to `bucket` rows give a spanning forest, larger ones a star around the smallest id. labelled: rows have a
    label, and buckets within one label are left out.
    """
    label = ["label"] if labelled else []
    banded = rows.select("doc_id", *label, F.explode("bands").alias("key"))
    counted = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), *(f(x) for x in label for f in (lambda x: F.min(x).alias("low"), lambda x: F.max(x).alias("high"))))
    buckets = cut_narrow(counted.filter("n > 1 and low < high" if labelled else "n > 1").select("key", "n", "first"), "buckets")
    shared = join_sized(banded.select("doc_id", "key"), buckets, "key", "n")
    star = shared.filter(F.col("n") > bucket).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    few = shared.filter(F.col("n") <= bucket).select("key", "doc_id").join(rows.select("doc_id", "n_shingles", "sig"), "doc_id").select("key", "doc_id", "n_shingles", "sig")
    forests = few.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_link_buckets(percent), "a long, b long")
    return forests.unionByName(star)


def rarest(shingle_set: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, by counts and then by hash: as many that two linked sets have one in common."""
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    order = np.lexsort((shingle_set, counts[(shingle_set >> shift).astype(np.int64)]))
    return shingle_set[order[: len(shingle_set) - -(-percent * len(shingle_set) // 100) + 1]]


def rare_shingles(texts: DataFrame, width: int, percent: int, size: int = COUNTS) -> DataFrame:
    """doc_id and bands, the rarest shingles of each text; rarity is counted over texts, in `size` counters."""
    shift = np.uint64(64 - (size.bit_length() - 1))

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, (shingles(text, width) >> shift).astype(np.int64), 1)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[slots], pa.int64())], ["slot", "n"])
        _WORDS.clear()

    counts = np.zeros(size, np.int64)
    for row in texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.slot] = row.n
    ranks = np.unique(counts, return_inverse=True)[1].astype(np.int32)

    def run(batches):
        for batch in (part for whole in batches for part in rows_per_task(whole, "text")):
            found = [rarest(shingles(t, width), ranks, percent).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "bands"])
        _WORDS.clear()
        release()

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, bands array<bigint>")


def _blocks_apart(left: DataFrame, block: int) -> DataFrame:
    """Of each group with several labels: how many, its classes n, the blocks (all: own, cells; owns) they are dealt to, and copies of a class.

    A label of many classes has blocks of its own, the others share blocks (own: -1).
    """
    by_label = left.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    by_label = by_label.withColumn("own", F.when(F.col("n") * 2 > block, F.col("label")).otherwise(-1))
    cells = by_label.groupBy("group", "own").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int").alias("cells"))
    copies = F.sum("cells") - F.sum(F.when(F.col("own") != -1, F.col("n") * F.col("cells")).otherwise(0)) / F.sum("n")
    return cells.groupBy("group").agg(F.sum("labels").alias("labels"), F.sum("n").alias("n"), copies.alias("copies"), F.collect_list(F.struct("own", "cells")).alias("all"), F.collect_set("own").alias("owns")).filter("labels > 1")


def divided(left: DataFrame, texts: DataFrame, width: int, percent: int, bucket: int) -> DataFrame:
    """The rows of left (doc_id, group, label, n_shingles, sig; written) in smaller groups, in which all links between labels lie."""
    wanted = texts.join(bounded_broadcast(left.select("doc_id"), left.count()), "doc_id", "left_semi")
    rare = rare_shingles(wanted, width, percent).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"))
    rows = left.join(rare, "doc_id").withColumn("bands", F.transform("bands", lambda x: F.xxhash64("group", x)))
    found = components(shared_links(cut(rows, "rare"), percent, bucket, labelled=True), "a", "b")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    anew = found.unionByName(roots).select(F.col("node").alias("doc_id"), F.col("component").alias("anew"))
    return left.join(anew, "doc_id").withColumn("group", F.col("anew")).drop("anew")


def verified_links(members: DataFrame, docs: DataFrame, width: int, percent: int, block: int = BLOCK, bucket: int = BUCKET, most_cells: int = CELLS) -> DataFrame:
    """Pairs (a, b) that connect what links, verified on full sets, connect in each group, and nothing else. members: doc_id, group, n_shingles, sig (written)."""
    texts = docs.join(bounded_broadcast(members.select("doc_id"), members.count()), "doc_id", "left_semi")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    groups = cut_narrow(members.groupBy("group").agg(F.count("*").alias("n"), blocks.alias("blocks")), "groups")
    sized = join_sized(members, groups, "group", "n")

    def verify(dealt: DataFrame, name: str) -> DataFrame:
        rows = dealt.join(texts, "doc_id").select("group", "part", "side", "doc_id", "label", "sig", "text")
        return cut(rows.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(_settle_groups(percent, width), "a long, b long"), name)

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        return large.join(found, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    def random_block(number: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(number)), F.col("blocks")).cast("string").alias("part")

    links = verify(sized.select("group", random_block(1), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("label"), "sig"), "links")
    if groups.filter("blocks > 1").isEmpty():
        return links
    large = cut_narrow(sized.filter("blocks > 1").select("group", "doc_id", "n_shingles", "sig", "blocks"), "large")
    links = links.unionByName(verify(labelled(links).select("group", random_block(2), F.lit(0).alias("side"), "doc_id", "label", "sig"), "links"))

    left = cut_narrow(labelled(links), "left")
    lists = cut_narrow(_blocks_apart(left, block), "lists")
    far = lists.filter(F.col("copies") > most_cells)
    if not far.isEmpty():
        # Pairs of blocks would cost the square of such a group: it is divided, and its parts are dealt anew.
        sizes = left.groupBy("group").agg(F.count("*").alias("rows")).join(far.select("group"), "group", "left_semi")
        apart = cut_narrow(join_sized(left, cut_narrow(sizes, "sizes"), "group", "rows").select("group", "doc_id", "label", "n_shingles", "sig"), "apart")
        near = lists.filter(F.col("copies") <= most_cells).select("group", F.col("n").alias("rows"))
        kept = join_sized(left, cut_narrow(near, "near"), "group", "rows").select(apart.columns)
        left = cut_narrow(kept.unionByName(divided(apart, texts, width, percent, bucket).select(apart.columns)), "left")
        lists = cut_narrow(_blocks_apart(left, block), "lists")
    if lists.isEmpty():
        return links
    placed = join_sized(left.select("group", "doc_id", "label", "sig"), lists, "group", "n")
    placed = placed.withColumn("own", F.when(F.array_contains("owns", F.col("label")), F.col("label")).otherwise(-1))
    width_of = F.filter("all", lambda c: c["own"] == F.col("own"))[0]["cells"]
    placed = placed.withColumn("mine", F.struct(F.col("own"), F.pmod(F.xxhash64("doc_id"), width_of).cast("int").alias("cell")))
    # Blocks of one component alone never meet, themselves included.
    met = F.filter("all", lambda c: (c["own"] != F.col("own")) | (c["own"] == -1))
    others = F.flatten(F.transform(met, lambda c: F.transform(F.sequence(F.lit(0), c["cells"] - 1), lambda i: F.struct(c["own"].alias("own"), i.cast("int").alias("cell")))))
    paired = placed.withColumn("other", F.explode(others)).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    part = F.concat_ws("|", "low.own", "low.cell", "high.own", "high.cell")
    side = ((F.col("low") != F.col("high")) & (F.col("mine") == F.col("high"))).cast("int")
    return links.unionByName(verify(paired.select("group", part.alias("part"), side.alias("side"), "doc_id", "label", "sig"), "links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", block: int = BLOCK, bucket: int = BUCKET, most_cells: int = CELLS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each document."""
    rows = band_rows(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(sign(docs, width, rows), "signed")
    linkable = F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()
    known = all_known = signed.filter(linkable)
    repeated = cut_narrow(known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    n_repeated = repeated.count()
    if n_repeated:
        repeated = bounded_broadcast(repeated, n_repeated)
        best = known.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "set_key", "bands", "sig"), F.struct("n_shingles", "set_key")).alias("x")).select("doc_id", "x.*")
        known = cut(known.join(repeated, "doc_id", "left_anti").unionByName(best), "known")

    classes = cut_narrow(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    copies = join_sized(known.select("doc_id", "set_key"), classes.filter("n > 1"), "set_key", "n").filter("doc_id <> rep").select("doc_id")
    reps = cut(known.join(copies, "doc_id", "left_anti").drop("set_key"), "reps")
    groups = components(shared_links(reps, percent, bucket), "a", "b")
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    members = groups.unionByName(roots).select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    members = cut_narrow(members.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id"), "members")
    final = components(verified_links(members, docs, width, percent, block, bucket, most_cells), "a", "b")

    # Classes whose documents may have a component other than themselves.
    moved = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").filter("n > 1 or component is not null")
    moved = cut_narrow(moved.select("set_key", "n", F.coalesce("component", "rep").alias("component")), "moved")
    found = join_sized(known.select("doc_id", "n_shingles", "set_key"), moved, "set_key", "n", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    if n_repeated:
        of_id = found.join(repeated, "doc_id", "left_semi").select("doc_id", "component_id")
        again = all_known.join(repeated, "doc_id", "left_semi").select("doc_id", "n_shingles").join(bounded_broadcast(of_id, n_repeated), "doc_id")
        found = found.join(repeated, "doc_id", "left_anti").unionByName(again)
    found = found.unionByName(signed.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), with the columns of the input, whatever their names.

    Null ids, texts without words and an empty table stay as they are; all rows of a kept id stay.
    """
    gone = cut(near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(bounded_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
