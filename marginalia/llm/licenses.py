"""License scans by a positional index of rare words.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Each template is a notice with
its words' positions and the key phrases that make it that license. For a file:

1. base phrases are found where their words stand in a row;
2. a template is a candidate if all words of its key phrases occur in the file;
3. of a candidate's words, the ``RARE`` with the highest inverse document frequency (over all documents) that
   the file holds are looked up. Their places less their postings in the template give the starts that they
   speak for; a start of any of them counts if at least half of the others agree within ``SLACK`` words. The places of the
   key phrases less their places in the template always give starts, whatever the rare words of the file say;
4. every key phrase must stand, word for word, inside the notice that begins there. The score is the share of the
   template's words that stand at their places, give or take ``SLACK``; at least ``SCORE`` is wanted.

The templates are the index: its size does not depend on the data.

Cases: null and empty texts have no words, no labels, null first and last word and the score 0; repeated rows are each
reported; an empty table gives no rows; several templates may give one label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import Terms, document_frequencies, words_of
from marginalia.llm.textbatch import TextBatch, hash_word

#: fixed values: base phrases and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: fixed values: label, notice, key phrases
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license", "2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("all-rights-reserved", "All rights reserved", ["all rights reserved"]),
]
RARE = 4
SLACK = 2
SCORE = 0.6


def words_in(text: str) -> list[str]:
    batch = TextBatch.of([text])
    data = batch.lowered().data.tobytes()
    spans = words_of(batch)
    return [data[a:b].decode() for a, b in zip(spans.starts, spans.ends)]


@dataclass
class Template:
    label: str
    words: np.ndarray
    phrases: list[np.ndarray]

    @property
    def key_words(self) -> np.ndarray:
        return np.unique(np.concatenate(self.phrases))


class Index:
    """Templates, base phrases and terms, with the terms' inverse document frequencies."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        given = [w for _, notice, keys in templates for w in words_in(notice) + [x for k in keys for x in words_in(k)]] + [w for p in base for w in words_in(p)]
        self.terms = Terms(np.array([hash_word(w) for w in given], dtype=np.uint64))
        numbers = lambda text: self.terms.numbers(np.array([hash_word(w) for w in words_in(text)], dtype=np.uint64))
        self.templates = [Template(label, numbers(notice), [numbers(k) for k in keys]) for label, notice, keys in templates]
        self.base = [(label, numbers(p)) for p, label in base.items()]
        self.idf = np.zeros(self.terms.size)


def runs(numbers: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Indexes at which the phrase's words stand in a row."""
    n = len(numbers) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(numbers[:n] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[numbers[at + i] == phrase[i]]
    return at


def fit_of(template: Template, numbers: np.ndarray, idf: np.ndarray) -> float:
    """Best share of the template's words that stand at their places in one notice of the file; 0 if there is none."""
    here = [w for w in np.unique(template.words) if (numbers == w).any()]
    rare = sorted(here, key=lambda w: (-idf[w], w))[:RARE]
    starts = [np.unique(np.subtract.outer(np.flatnonzero(numbers == w), np.flatnonzero(template.words == w))) for w in rare]
    every = np.unique(np.concatenate(starts))
    # a start agrees with itself
    agree = sum(np.searchsorted(s, every + SLACK, side="right") > np.searchsorted(s, every - SLACK) for s in starts) - 1
    spoken = [np.subtract.outer(runs(numbers, p), runs(template.words, p)).ravel() for p in template.phrases]
    best = 0.0
    for start in np.unique(np.concatenate([every[2 * agree >= len(rare) - 1], *spoken])):
        lo, hi = max(0, start - SLACK), max(0, start + len(template.words) + SLACK)
        if not all(len(runs(numbers[lo:hi], p)) for p in template.phrases):
            continue
        near = [bool((numbers[max(0, start + i - SLACK) : max(0, start + i + SLACK + 1)] == w).any()) for i, w in enumerate(template.words)]
        best = max(best, float(np.mean(near)))
    return best


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            words = words_of(batch)
            numbers = index.terms.numbers(words.hashes)
            n = batch.n_docs
            labels: list[set[str]] = [set() for _ in range(n)]
            base, first, last, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
            for label, phrase in index.base:
                at = runs(numbers, phrase)
                at = at[words.docs[at] == words.docs[at + len(phrase) - 1]]
                docs = words.docs[at]
                base += np.bincount(docs, minlength=n)
                np.minimum.at(first, docs, at - words.firsts[docs])
                np.maximum.at(last, docs, at - words.firsts[docs])
                for d in np.unique(docs):
                    labels[d].add(label)
            base_labels = [",".join(sorted(x)) for x in labels]
            known = np.flatnonzero(numbers >= 0)
            cells = np.unique(words.docs[known] * index.terms.size + numbers[known])
            of, term = cells // index.terms.size, cells % index.terms.size
            for template in index.templates:
                keys = template.key_words
                held = np.bincount(of[np.isin(term, keys)], minlength=n)
                for d in np.flatnonzero(held == len(keys)):
                    fit = fit_of(template, numbers[words.firsts[d] : words.firsts[d + 1]], index.idf)
                    if fit >= SCORE:
                        labels[d].add(template.label)
                        score[d] = max(score[d], fit)
            none = base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).slice(lo, hi - lo), pa.array(words.counts), pa.array(base), pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none),
                    pa.array(base_labels, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(np.round(score, 6)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """Words, base places and labels, all labels and the best score of every row."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = index or Index()
    index.idf = np.log((docs.count() + 1) / (document_frequencies(docs, index.terms) + 1))
    return docs.mapInArrow(partial(_scan, index), OUT)
