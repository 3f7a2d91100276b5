"""Byte-pair encoding and decoding with a vocabulary in the tokenizers library's JSON format.

A piece of text is merged with a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose
symbols have changed are stale and skipped. Ids are packed little-endian unsigned 32-bit integers (binary), and decoding
concatenates vocabulary strings. Null text counts as empty: no ids, and '' decoded. Repeated rows give repeated results.
Null document ids pass through, an empty table gives none, and very long texts are encoded whole, in a batch of their own.
Input columns named as the new ones are replaced; others may have any names.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import plus, rows_per_task, ship

#: The byte-level pre-tokenizer's pattern, with white space as the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same pattern for Python's re, whose classes agree on all characters but those of UNUSUAL (and those beyond U+024F).
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: Pieces kept encoded in a Python worker; the store is emptied when full.
CACHE = 400_000


def pieces(text: str) -> list[str]:
    """The pre-tokenizer's pieces of a text; joined, they are the text."""
    return (PIECES if UNUSUAL.search(text) else LATIN_PIECES).findall(text)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE(dict):
    """Encoder and decoder; as a mapping, from pieces of text to their packed ids."""

    def __init__(self, spec: bytes) -> None:
        super().__init__()
        spec = json.loads(spec)
        letters = byte_letters()
        vocab, byte_of = spec["model"]["vocab"], {c: b for b, c in letters.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        top = range(max(self.bytes_of) + 1)
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in top], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in top), np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece. O(n log n) for n bytes. A queue entry is a rank and a position; it is stale unless the pair
        that now starts there has that rank."""
        symbols = [self.single[b] for b in data]
        n, rank_of, merged_of = len(symbols), self.ranks.get, self.merged
        rank = [rank_of(pair, -1) for pair in pairwise(symbols)]
        queue = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not queue:
            return symbols
        rank.append(-1)
        heapq.heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            if rank[i] != entry >> 32:
                continue
            j = after[i]
            symbols[i] = x = merged_of[rank[i]]
            symbols[j], rank[j] = -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = r = rank_of((x, symbols[k]), -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = rank_of((symbols[h], x), -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | h)
        return [x for x in symbols if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        packed = b"".join(x.to_bytes(4, "little") for x in self.merge(piece.encode()))
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; special tokens inside it are taken as such."""
        look = self.__getitem__
        if not self.special or not any(s in text for s in self.special):
            return b"".join(map(look, pieces(text)))
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(look, pieces(part))) for part in self.split_special.split(text) if part)

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings of packed ids, one after another: bytes are gathered from the joined vocabulary."""
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.joined[at].tobytes().decode("utf-8", "replace")


_CODERS: dict[int, ByteBPE] = {}


def coder(spec: bytes) -> ByteBPE:
    """The worker's encoder for a vocabulary file."""
    if (key := hash(spec)) not in _CODERS:
        _CODERS[key] = ByteBPE(spec)
    return _CODERS[key]


def read_spec(path: str) -> bytes:
    """A vocabulary file of a few MB, sent to the executors from the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of packed ids, and one of the text decoded from them if named. Input columns of such names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    sent, names = docs.sparkSession.sparkContext.broadcast(read_spec(path)), docs.columns

    def run(batches):
        c = coder(sent.value)
        for whole in batches:
            for batch in rows_per_task(whole, text):
                packed = [c.encode(t or "") for t in batch.column(names.index(text)).to_pylist()]
                new = [pa.array(packed, pa.binary())]
                if decoded:
                    new.append(pa.array([c.decode(x) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, plus(docs, **{ids: "binary"} | ({decoded: "string"} if decoded else {})))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text of a column of packed ids; null ids give ''."""
    ship(docs.sparkSession)
    docs = docs.drop(decoded)
    sent, names = docs.sparkSession.sparkContext.broadcast(read_spec(path)), docs.columns

    def run(batches):
        c = coder(sent.value)
        for batch in batches:
            texts = [c.decode(x or b"") for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, decoded])

    return docs.mapInArrow(run, plus(docs, **{decoded: "string"}))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
