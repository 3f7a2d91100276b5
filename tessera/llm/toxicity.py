"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is trained in numpy from documents confirmed as toxic
(positives) and from unlabelled text, by the non-negative risk estimator: prior * R(positive as 1) + max(0, R(unlabelled as
0) - prior * R(positive as 0)), with the logistic loss. Where the bracket falls below zero on a batch, the step goes against
it, as the estimator prescribes. The class prior is the share of toxic rows among the labelled training rows. Words are
maximal runs of letters, lower-cased; beginnings stand for stems. Features are whether a text has a word, whether a word of
it has a beginning, and whether one word in DENSE or more has it. A score looks at every word of the whole text.

Training reads a sample bounded by MAX_POSITIVE and MAX_UNLABELLED documents; every word of the sample that tells the two
apart is a feature, without a cap. Features are counted by Spark; the driver receives telling ones and rows over them.

Null and empty texts score the bias alone. Null labels are not learnt from; null ids are, as unlabelled text. Rows that
repeat a text count once in training and are scored each. Very long texts are scored whole. Without a positive or without
unlabelled text every score is 0; an empty table gives none. An input column score is replaced by score(), others pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, id_remainder, plus, release, rows_per_task, ship

#: Bounds of the training sample (documents); what makes a feature part of the model; lengths of word beginnings.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
MIN_DOCS, MIN_LIFT, MIN_Z = 3, 2.0, 4.0
BEGINNINGS, DENSE = (4, 5, 6, 7), 100
EPOCHS, RATE, DECAY, BATCHES, BETA = 60, 0.05, 1e-4, 12, 0.0
THRESHOLD, CACHE = 0.3, 250_000
WORDS = re.compile(r"[^\W\d_]+")


def _key(text: str) -> int:
    return zlib.crc32(text.encode())


def _begin(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if len(word) >= k]


def words_of(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def features(text: str | None) -> np.ndarray:
    """All features of a text as crc32, sorted."""
    words, begun = words_of(text), Counter()
    for w, n in words.items():
        for b in _begin(w):
            begun[b] += n
    total = sum(words.values())
    dense = (_key(b + "%") for b, n in begun.items() if n * DENSE >= total)
    return np.unique(np.array([*map(_key, words), *(_key(b + "*") for b in begun), *dense], np.uint32))


def _feature_ids(batches):
    for whole in batches:
        for batch in rows_per_task(whole, "text", 2 << 20):
            packed = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["toxic", "features", "mix"])
    release()


def _count_features(batches):
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        held = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
        found, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_inverse=True)
        by = np.bincount(at, np.repeat(toxic, [len(x) for x in held]), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(by), pa.array(np.bincount(at, minlength=len(found)).astype(np.int64) - by)], ["feature", "pos", "unl"])
    release()


def _sample(docs: DataFrame, most: int, toxic: int) -> DataFrame:
    """About `most` whole documents, chosen by a hash of id and text: columns toxic and features, equal texts once."""
    share = min(1.0, most / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    rows = chosen.select(F.lit(toxic).alias("toxic"), "text", F.xxhash64("text").alias("mix"))
    return rows.mapInArrow(_feature_ids, "toxic int, features binary, mix long").dropDuplicates(["toxic", "mix"]).drop("mix")


def telling_features(sample: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
    """Features in more positive than unlabelled documents by a factor of MIN_LIFT and by MIN_Z standard errors."""
    counts = sample.mapInArrow(_count_features, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    p, u = F.col("pos") / n_pos, (F.col("unl") + 0.5) / (n_unl + 1)
    z = (p - u) / F.sqrt(u * (1 - F.least(u, F.lit(0.99))) * (1 / n_pos + 1 / n_unl))
    good = counts.filter((F.col("pos") >= MIN_DOCS) & (p >= MIN_LIFT * u) & (z >= MIN_Z)).select("feature")
    return np.sort(good.toArrow()["feature"].to_numpy().astype(np.uint32))


def nn_risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk at scores of positives and unlabelled rows, and the direction of the step by row (positives first)."""
    soft = lambda z: np.logaddexp(0, z)  # noqa: E731  loss of calling z negative
    sig = lambda z: 0.5 * (1 + np.tanh(z / 2))
    as_one = prior * soft(-pos).mean()
    negative = soft(unl).mean() - prior * soft(pos).mean()
    by_row = np.concatenate([-prior * sig(pos) / len(pos), sig(unl) / len(unl)])  # gradient of the bracket
    if negative < -BETA:
        return float(as_one + max(0.0, negative)), -by_row
    return float(as_one + max(0.0, negative)), by_row + np.concatenate([prior * (sig(pos) - 1) / len(pos), np.zeros(len(unl))])


def train(positives: DataFrame, unlabelled: DataFrame, prior: float) -> dict[str, Any]:
    """Weights of features (crc32) and a bias, from two frames with doc_id and text."""
    ship(positives.sparkSession)
    sample = cut(_sample(positives, MAX_POSITIVE, 1).unionByName(_sample(unlabelled, MAX_UNLABELLED, 0)), "sample")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    if len(size) < 2:
        return {"words": np.zeros(0, np.uint32), "weights": np.zeros(0), "bias": -np.inf}
    vocab = telling_features(sample, size[1], size[0])
    sent = positives.sparkSession.sparkContext.broadcast(vocab)

    def over_vocab(batches):
        known = sent.value
        for batch in batches:
            rows = [np.flatnonzero(np.isin(known, np.frombuffer(x, np.uint32))).astype(np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["toxic", "at"])

    table = sample.mapInArrow(over_vocab, "toxic int, at binary").toArrow()  # rows of the bounded sample over telling features
    rows = sorted(zip(table["toxic"].to_pylist(), table["at"].to_pylist(), strict=True))
    pos, unl = ([np.append(np.frombuffer(x, np.int32), len(vocab)) for t, x in rows if t == k] for k in (1, 0))  # the last column is the bias
    w = np.zeros(len(vocab) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.Generator(np.random.PCG64(7))
    mean, averaged = np.zeros_like(w), 0  # of the weights after each epoch of the second half: steps against the bracket swing
    for epoch in range(EPOCHS):
        p_parts, u_parts = np.array_split(rng.permutation(len(pos)), BATCHES), np.array_split(rng.permutation(len(unl)), BATCHES)
        for p, u in zip(p_parts, u_parts, strict=True):
            if not len(p) or not len(u):
                continue
            held = [pos[i] for i in p] + [unl[i] for i in u]
            sizes = np.array([len(x) for x in held])
            flat, begin = np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores = np.add.reduceat(w[flat], begin)
            _, by_row = nn_risk(scores[: len(p)], scores[len(p) :], prior)
            grad = np.bincount(flat, np.repeat(by_row, sizes), len(w))
            grad[:-1] += DECAY * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if epoch >= EPOCHS // 2:
            mean, averaged = mean + w, averaged + 1
    mean /= averaged
    return {"words": vocab, "weights": mean[:-1], "bias": float(mean[-1])}


class _Weights(dict):
    """From a word to its own weight and the beginnings of it that the model knows, for most words 0 and none."""

    def __init__(self, model: dict[str, Any]) -> None:
        super().__init__()
        self.known, self.bias = dict(zip(model["words"].tolist(), model["weights"].tolist(), strict=True)), model["bias"]

    def __missing__(self, word: str) -> tuple[float, tuple[str, ...]]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = x = (self.known.get(_key(word), 0.0), tuple(b for b in _begin(word) if _key(b + "*") in self.known or _key(b + "%") in self.known))
        return x

    def score(self, text: str | None) -> float:
        words, z, begun = words_of(text), 0.0, Counter()
        for w in sorted(words):
            weight, beginnings = self[w]
            z += weight
            for b in beginnings:
                begun[b] += words[w]
        total = sum(words.values())
        for b, n in begun.items():
            z += self.known.get(_key(b + "*"), 0.0) + (self.known.get(_key(b + "%"), 0.0) if n * DENSE >= total else 0.0)
        return 0.5 * (1 + float(np.tanh((z + self.bias) / 2)))


def score(docs: DataFrame, model: dict[str, Any], text: str = "text") -> DataFrame:
    """docs with score; a narrow step. An input column score is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        weights = _Weights(sent.value)
        for batch in (part for whole in batches for part in rows_per_task(whole, text)):
            found = [weights.score(t) for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])
        release()

    return docs.mapInArrow(run, plus(docs, score="double"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    usable = labels.filter(~held_out & F.col("toxic").isNotNull())
    counts = usable.agg(F.avg("toxic").alias("prior")).first()
    prior = min(0.9, max(0.01, counts.prior or 0.01))
    positives = docs.join(usable.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    model = train(positives, docs.filter(~held_out), prior)
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
