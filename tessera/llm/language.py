"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree (contexts of 0 to 3 bytes). A byte is coded by the longest known
context that has seen it; every context left on the way costs its escape (method C: distinct successors over
occurrences plus successors, without exclusions; a byte never seen costs 8 bits below order 0). Statistics are frozen,
so a byte's cost depends on four bytes only: costs are tabulated once, in fixed point, and a text's code length is an
exact integer sum over all its bytes. The shortest code wins; ties go to the first language by name.

Null texts and texts without a letter get `und` and score 0. Texts are lower-cased in A-Z and preceded by three spaces.
Null ids are never trained on. Repeated rows give repeated results; other columns are not read. Very long texts are coded
whole, by chunks; an empty table gives none.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, id_remainder, plus, release, rows_per_task, ship

#: Bound of the training sample: documents for each language. Every four-byte string of the sample and its contexts are kept.
MAX_TRAIN_DOCS = 2000
SCALE = 4096  # cost units in a bit
PAD, CHUNK = b"   ", 1 << 17
UNDETERMINED = "und"
PLAIN_BITS = 8.0  # bits for a byte that no model helps to code


def _strings(data: bytes) -> np.ndarray:
    """All four-byte strings as integers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _codes(text: str) -> np.ndarray:
    """All four-byte strings of a padded text, one for each of its bytes."""
    return _strings(PAD + text.encode().lower())


def _count_grams(batches):
    for whole in batches:
        for batch in rows_per_task(whole, "text", 2 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                parts = [_codes(t) for t, x in zip(texts, langs, strict=True) if x == lang and t]
                if not parts:
                    continue
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def training_sample(docs: DataFrame, most: int = MAX_TRAIN_DOCS) -> DataFrame:
    """At most about `most` labelled documents of each language, chosen by a hash of the id; whole texts."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = F.lit(0.0)
    for row in known.groupBy("lang").count().collect():  # one row for each language
        share = F.when(F.col("lang") == row.lang, F.lit(min(1.0, most / row["count"]))).otherwise(share)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")


def train(docs: DataFrame, most: int = MAX_TRAIN_DOCS) -> dict[str, Any]:
    """Cost tables from labelled documents (columns doc_id, lang, text). No labelled document gives a model without languages."""
    ship(docs.sparkSession)
    counts = training_sample(docs, most).mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts, "grams")  # counted once, for the names and for the table
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    number = F.lit(0)
    for k, name in enumerate(langs):
        number = F.when(F.col("lang") == name, k).otherwise(number)
    table = counts.select(number.cast("int").alias("k"), "gram", "n").toArrow()
    return _tabulate(langs, *(table[c].to_numpy() for c in ("k", "gram", "n")))


def _cost(p: np.ndarray) -> np.ndarray:
    return np.round(-np.log2(p) * SCALE).astype(np.int32)


def _predict(count: np.ndarray, context: np.ndarray, size: int, shorter: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of symbols after contexts, escaping to the shorter context's; and each context's escape."""
    total, distinct = np.bincount(context, count, size), np.bincount(context, count > 0, size)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    return np.where(count > 0, count / np.maximum(total + distinct, 1)[context], escape[context] * shorter), escape


def _sparse(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, where each key's entries begin, and the entries' languages and values, from (keys, values) by language."""
    keys = np.concatenate([k for k, _ in parts]).astype(np.uint32)
    lang = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(k) for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    found, begin = np.unique(keys[order], return_index=True)
    return found, np.append(begin, len(keys)).astype(np.int64), lang[order], np.concatenate([v for _, v in parts]).astype(np.int32)[order]


def _tabulate(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict[str, Any]:
    """Costs: a dense table of the shortest contexts, and by sorted strings what a language adds that has seen them."""
    if not langs:
        return {"langs": []}
    pairs = np.arange(1 << 16)
    low, suffixes, contexts, grams = np.zeros((1 << 16, len(langs)), np.int32), [], [], []
    escape_low = np.zeros_like(low)
    for k in range(len(langs)):
        mine = np.flatnonzero(lang == k)
        g4, c4 = gram[mine], n[mine].astype(np.float64)
        g3, of_suffix = np.unique(g4 & 0xFFFFFF, return_inverse=True)
        before, of_context = np.unique(g4 >> 8, return_inverse=True)
        c3 = np.bincount(of_suffix, c4, len(g3))
        c2 = np.bincount(g3 & 0xFFFF, c3, 1 << 16)
        c1 = np.bincount(pairs & 0xFF, c2, 256)
        p0, _ = _predict(c1, np.zeros(256, np.int64), 1, 1 / 256)
        p1, _ = _predict(c2, pairs >> 8, 256, p0[pairs & 0xFF])
        p2, escape2 = _predict(c3, g3 >> 8, 1 << 16, p1[g3 & 0xFFFF])
        p3, escape3 = _predict(c4, of_context, len(before), p2[of_suffix])
        low[:, k], escape_low[:, k] = _cost(p1), _cost(escape2)
        suffixes.append((g3, _cost(p2) - low[g3 & 0xFFFF, k] - escape_low[g3 >> 8, k]))
        contexts.append((before, _cost(escape3)))
        grams.append((g4, _cost(p3) - _cost(escape3)[of_context] - _cost(p2)[of_suffix]))
    return {"langs": langs, "low": low, "escape_low": escape_low, "tables": [_sparse(suffixes), _sparse(contexts), _sparse(grams)]}


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Scorer:
    """Lookups in a model."""

    def __init__(self, m: dict[str, Any]) -> None:
        self.m, self.langs = m, m["langs"]

    def _add(self, total: np.ndarray, table: int, keys: np.ndarray, times: np.ndarray) -> None:
        """Add to the languages what one sparse table holds for the keys, each that many times."""
        held, begin, lang, value = self.m["tables"][table]
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        hit = held[at] == keys
        at, times = at[hit], times[hit]
        sizes = begin[at + 1] - begin[at]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[at] - ends + sizes, sizes)
        sums = np.bincount(lang[entry], value[entry] * np.repeat(times, sizes).astype(np.float64), len(self.langs))
        total += np.rint(sums).astype(np.int64)  # exact: integers far below 2 ** 53

    def code_lengths(self, text: str) -> np.ndarray:
        """Cost of the whole text under each language."""
        data, total = PAD + text.encode().lower(), np.zeros(len(self.langs), np.int64)
        for start in range(0, len(data) - 3, CHUNK):
            grams, times = np.unique(_strings(data[start : start + CHUNK + 3]), return_counts=True)
            last = grams & np.uint32(0xFFFFFF)
            total += times @ self.m["low"][last & np.uint32(0xFFFF)] + times @ self.m["escape_low"][last >> np.uint32(8)]
            for table, keys in enumerate((last, grams >> np.uint32(8), grams)):
                self._add(total, table, keys, times)
        return total

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, its posterior under equal priors, and bits for each byte."""
        if not self.langs or not lettered(text):
            return UNDETERMINED, 0.0, 0.0
        bits = self.code_lengths(text) / SCALE
        best = int(bits.argmin())
        return self.langs[best], 1.0 / sum(2.0 ** max(-1000.0, bits[best] - x) for x in bits), float(bits[best]) / max(1, len(text.encode()))

    def known(self, text: str | None) -> bool:
        """Whether the text has letters and, if any language was learnt, is in one of them."""
        return lettered(text) and (not self.langs or self.judge(text)[2] < PLAIN_BITS)


def identify(docs: DataFrame, model: dict[str, Any], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte; a narrow step. An input column of such a name is replaced."""
    ship(docs.sparkSession)
    added = ("lang_pred", "score", "bits_per_byte")
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def judge(batches):
        s = Scorer(sent.value)  # freed with the task
        for whole in batches:
            for batch in rows_per_task(whole, text):
                found = [s.judge(t) for t in batch.column(names.index(text)).to_pylist()]
                new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, *added])
        del s
        release()

    return docs.mapInArrow(judge, plus(docs, lang_pred="string", score="double", bits_per_byte="double"))


def _trainable(docs: DataFrame) -> DataFrame:
    return docs.filter(id_remainder(F.col("doc_id"), 3) != 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(_trainable(docs.select("doc_id", "lang", "text"))))
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose best language codes them in fewer than 8 bits a byte, with the columns of the input.

    At 8 bits a byte a model knows nothing of a text: hex or base64 dumps and other scripts. Where no language could be
    learnt, every document with a letter stays. Null ids and repeated rows are judged each; other columns pass, whatever
    their names.
    """
    model = train(_trainable(docs.select("doc_id", "lang", "text")))
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns

    def kept(batches):
        s = Scorer(sent.value)  # freed with the task
        for whole in batches:
            for batch in rows_per_task(whole, "text"):
                yield batch.filter(pa.array([s.known(t) for t in batch.column(names.index("text")).to_pylist()], pa.bool_()))
        del s
        release()

    return docs.mapInArrow(kept, docs.schema)
