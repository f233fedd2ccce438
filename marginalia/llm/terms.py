"""A bounded set of terms: their numbers in texts, and in how many documents each occurs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.textbatch import PUNCTUATION, Spans, TextBatch

_TABLE_BITS = 20


class Terms:
    """Term numbers of word hashes."""

    def __init__(self, hashes: np.ndarray, bits: int = _TABLE_BITS):
        self.hashes = np.unique(hashes)
        self.size = len(self.hashes)
        self.mask = np.uint64((1 << bits) - 1)
        slots = (self.hashes & self.mask).astype(np.int64)
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        self.table[slots] = np.arange(self.size)
        self.crowded = np.flatnonzero(np.bincount(slots, minlength=1 << bits) > 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words that are no term."""
        slots = (hashes & self.mask).astype(np.int64)
        out = self.table[slots]
        out[self.hashes[out] != hashes] = -1
        if len(self.crowded):
            again = np.flatnonzero(np.isin(slots, self.crowded))
            at = np.minimum(np.searchsorted(self.hashes, hashes[again]), self.size - 1)
            out[again] = np.where(self.hashes[at] == hashes[again], at, -1)
        return out


def words_of(batch: TextBatch) -> Spans:
    return batch.lowered().spans(PUNCTUATION)


def _frequencies(terms: Terms, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(terms.size, dtype=np.int64)
    for rows in batches:
        for _, _, batch in TextBatch.pieces(rows.column(0)):
            words = words_of(batch)
            number = terms.numbers(words.hashes)
            known = number >= 0
            cell = words.docs[known] * terms.size + number[known]
            if batch.n_docs * terms.size <= 1 << 24:
                seen = np.zeros(batch.n_docs * terms.size, dtype=bool)
                seen[cell] = True
                total += seen.reshape(batch.n_docs, terms.size).sum(axis=0)
            else:
                total += np.bincount(np.unique(cell) % terms.size, minlength=terms.size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "df": pa.array(total[at], pa.int64())})


def document_frequencies(docs: DataFrame, terms: Terms, text: str = "text") -> np.ndarray:
    """Documents that hold each term, counted over all rows; as many numbers as there are terms come to the driver."""
    counts = docs.select(text).mapInArrow(partial(_frequencies, terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(terms.size)
    for r in counts.collect():
        out[r["term"]] = r["df"]
    return out
