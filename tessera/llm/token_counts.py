"""Token counts of sections: a document is encoded once, and its tokens are attributed by their character spans.

A token belongs to the section that holds most of its characters; on a tie, to the one that starts earlier, then to the one
given earlier. A token of some bytes of a character spans that whole character. Tokens outside all sections are counted
under section -1. Sections are spans in any order, which may overlap, be empty or reach beyond the text; a null section or
bound makes it empty. By default they are the lines of the text, each with its line feed (an empty or null text is one line
without characters). The interval join of tokens and sections is done where the document lies: no shuffle.

Rows that repeat an id are counted each; null ids are returned as null; very long texts are encoded whole; an empty table
gives none. Only the id, the text and the sections are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import CACHE, ByteBPE, coder, pieces, read_spec
from .runtime import rows_per_task, ship


class TokenSpans(dict):
    """From a piece of text to the byte lengths of its tokens, each a byte (no token of these vocabularies exceeds 255)."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe, self.length = bpe, {i: len(b) for i, b in bpe.bytes_of.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        sizes = bytes(self.length[i] for i in self.bpe.merge(piece.encode()))
        if len(piece) <= 64:
            self[piece] = sizes
        return sizes

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token of a whole text; the strings of special tokens are ordinary text."""
        sizes = np.frombuffer(b"".join(map(self.__getitem__, pieces(text))), np.uint8)
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = ends - sizes
        data = text.encode()
        if len(data) > len(text):
            char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            return char[starts], char[ends - 1] + 1
        return starts, ends


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a text's lines, each with its line feed."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def attribute(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The section of each token, -1 for none; tokens (in order) and sections as spans."""
    order = np.argsort(first, kind="stable")
    f, e = first[order], np.maximum(end, first)[order]
    if len(f) and (f[1:] < e[:-1]).any():
        found = _attribute_overlapping(starts, ends, f, e)
    else:
        low = np.searchsorted(e, starts, side="right")
        high = np.searchsorted(f, ends, side="left") - 1
        found = np.where(low <= high, low, -1)
        for t in np.flatnonzero(low < high):
            s = np.arange(low[t], high[t] + 1)
            found[t] = s[np.argmax(np.minimum(e[s], ends[t]) - np.maximum(f[s], starts[t]))]
        held = np.flatnonzero(found >= 0)
        found[held[f[found[held]] == e[found[held]]]] = -1  # an empty section has no character
    return np.where(found >= 0, order[found], -1) if len(f) else found


def _attribute_overlapping(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sections sorted by start, which may overlap: one after another, each takes the tokens of which it holds more than those before."""
    found, most = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    for s, (a, b) in enumerate(zip(first, end, strict=True)):
        at = np.arange(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left"))
        held = np.minimum(ends[at], b) - np.maximum(starts[at], a)
        better = held > most[at]
        found[at[better]], most[at[better]] = s, held[better]
    return found


def count_tokens(docs: DataFrame, path: str, text: str = "text", sections: str | None = None) -> DataFrame:
    """doc_id, section (from 0), n_chars, n_tokens and n_crossing (attributed tokens that cross a boundary), one row for each section.

    sections: a column of array<struct<start: long, end: long>> in characters; null or empty: no section. Section -1 appears
    where tokens lie outside all sections.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", text, *([sections] if sections else []))
    sent, id_type = docs.sparkSession.sparkContext.broadcast(read_spec(path)), docs.schema["doc_id"].dataType.simpleString()
    spans: dict[str, TokenSpans] = {}

    def run(batches):
        if "it" not in spans:
            spans["it"] = TokenSpans(coder(sent.value))
        for whole in batches:
            for batch in rows_per_task(whole, text, 4 << 20):
                rows, out = [], []
                given = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
                for i, (t, cuts) in enumerate(zip(batch.column(1).to_pylist(), given, strict=True)):
                    t = t or ""
                    starts, ends = spans["it"].of(t)
                    if sections:
                        spans_of = [(0, 0) if c is None or c["start"] is None or c["end"] is None else (c["start"], c["end"]) for c in cuts or []]
                        first, end = np.array(spans_of, np.int64).reshape(-1, 2).T
                    else:
                        first, end = lines(t)
                    at = attribute(starts, ends, first, end)
                    crossing = np.flatnonzero((at >= 0) & ((starts < first[at]) | (ends > end[at]))) if len(first) else np.zeros(0, np.int64)
                    n, c = (np.bincount(x + 1, minlength=len(first) + 1) for x in (at, at[crossing]))
                    for s in range(-1 if n[0] else 0, len(first)):
                        rows.append(i)
                        out.append((s, max(0, int(end[s] - first[s])) if s >= 0 else None, int(n[s + 1]), int(c[s + 1])))
                columns = [pa.array([r[k] for r in out], pa.int32() if k == 0 else pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *columns], ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    return docs.mapInArrow(run, f"doc_id {id_type}, section int, n_chars long, n_tokens long, n_crossing long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
