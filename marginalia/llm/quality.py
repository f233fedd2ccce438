"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule is a predicate over one fact of a text. A sample tells what computing a
rule costs per text and how many texts it rejects; rules then run in descending order of
rejection per cost, and a text leaves the cascade at the first rule that rejects it, so
later rules see survivors only. The order changes the work and ``rejected_by``, never
``kept``: a text is kept if no rule rejects it.

Cases: a null or empty text has no words and fails ``few_words``; repeated rows are
judged alike; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.textbatch import BLANKS, NEWLINE, Spans, TextBatch

#: rows (about) whose rules are timed; all rows of a smaller table
SAMPLE_ROWS = 2_000
SYMBOLS = b"#*$%&|<>"


class Facts:
    """Facts of a batch of texts, each computed when first asked for."""

    def __init__(self, batch: TextBatch):
        self.batch = batch
        self._known: dict[str, np.ndarray | Spans] = {}

    def __getitem__(self, name: str):
        if name not in self._known:
            self._known[name] = getattr(self, "_" + name)()
        return self._known[name]

    def _count(self, members: bytes) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        return self.batch.sum_by_doc(table[self.batch.data])

    def _words(self) -> Spans:
        return self.batch.spans(BLANKS)

    def _n_words(self) -> np.ndarray:
        return self["words"].counts

    def _word_chars(self) -> np.ndarray:
        return self.batch.sum_by_doc(~BLANKS[self.batch.data] & self.batch.character_starts)

    def _n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS)

    def _lines(self) -> Spans:
        return self.batch.spans(NEWLINE)

    def _lines_with_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each line that has a word."""
        lines = self["lines"]
        seen = np.concatenate([[0], np.cumsum(~BLANKS[self.batch.data])])
        real = seen[lines.ends] > seen[lines.starts]
        return lines.hashes[real], lines.docs[real]

    def _n_dup_lines(self) -> np.ndarray:
        hashes, docs = self["lines_with_words"]
        order = np.lexsort((hashes, docs))
        h, d = hashes[order], docs[order]
        again = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[1:][again], minlength=self.batch.n_docs).astype(np.int64)

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self["lines_with_words"][1], minlength=self.batch.n_docs).astype(np.int64)

    def _n_repeat_words(self) -> np.ndarray:
        """Words that lie in a 3-word window found twice or more in their text."""
        words = self["words"]
        n = len(words.starts)
        if n < 3:
            return np.zeros(self.batch.n_docs, dtype=np.int64)
        hashes, docs = words.windows(3)
        first = np.flatnonzero(words.docs[: n - 2] == words.docs[2:])
        order = np.lexsort((hashes, docs))
        h, d = hashes[order], docs[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        repeated = np.zeros(len(h), dtype=bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        at = first[order[repeated]]
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[at + i] = True
        return np.bincount(words.docs[covered], minlength=self.batch.n_docs).astype(np.int64)

    def _n_upper(self) -> np.ndarray:
        return self._count(bytes(range(0x41, 0x5B)))

    def _n_lower(self) -> np.ndarray:
        return self._count(bytes(range(0x61, 0x7B)))

    def _n_digits(self) -> np.ndarray:
        return self._count(b"0123456789")

    def _longest_word(self) -> np.ndarray:
        """Bytes of the longest word."""
        words = self["words"]
        out = np.zeros(self.batch.n_docs, dtype=np.int64)
        np.maximum.at(out, words.docs, words.ends - words.starts)
        return out


@dataclass(frozen=True)
class Rule:
    """``rejects(facts)`` is True for the texts that the rule rejects."""

    name: str
    rejects: Callable[[Facts], np.ndarray]


def share_rule(name: str, part: str, whole: str, most: float) -> Rule:
    """Rejects texts in which ``part`` exceeds ``most`` of ``whole``."""
    return Rule(name, lambda f: f[part] > most * f[whole])


#: base rules: too few words, or too many in repeated windows
BASE = [
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
]
#: rules of the method
RULES = [
    *BASE,
    share_rule("symbols", "n_symbols", "n_words", 0.3),
    share_rule("repeated_lines", "n_dup_lines", "n_lines", 0.5),
    Rule("shouting", lambda f: f["n_upper"] > 0.5 * (f["n_upper"] + f["n_lower"])),
    share_rule("digits", "n_digits", "word_chars", 0.3),
    Rule("word_length", lambda f: (f["word_chars"] > 20 * f["n_words"]) | (f["word_chars"] < 2 * f["n_words"])),
    Rule("unbroken", lambda f: f["longest_word"] > 1000),
]


def cascade(batch: TextBatch, rules: list[Rule], facts: Facts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the rejecting rule (-1: kept) of each text, and texts that each rule judged."""
    verdict = np.full(batch.n_docs, -1, dtype=np.int64)
    judged = np.zeros(len(rules), dtype=np.int64)
    alive = np.arange(batch.n_docs)
    current = facts or Facts(batch)
    held = alive
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        if len(alive) < 0.7 * len(held):  # later facts are worth computing for the survivors alone
            current, held = Facts(batch.take(alive)), alive
        bad = rule.rejects(current)[np.searchsorted(held, alive)]
        judged[i] = len(alive)
        verdict[alive[bad]] = i
        alive = alive[~bad]
    return verdict, judged


def _measure(rules: list[Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spent, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64), 0
    for rows in batches:
        for _, _, batch in TextBatch.pieces(rows.column(0)):
            seen += batch.n_docs
            for i, rule in enumerate(rules):
                began = time.thread_time()
                bad = rule.rejects(Facts(batch))
                spent[i] += time.thread_time() - began
                rejected[i] += int(bad.sum())
    yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "seen": [seen] * len(rules), "rejected": rejected, "seconds": spent})


def measure(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Cost and rejections of each rule over a sample of about ``rows`` rows, summed over tasks."""
    total = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, rows / max(total, 1)), seed=7)
    parts = sample.mapInArrow(partial(_measure, rules), "rule string, seen bigint, rejected bigint, seconds double")
    return parts.groupBy("rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def ordered(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, best first; equal ones keep their given order. One row per rule comes to the driver."""
    found = {r["rule"]: r for r in measure(docs, rules, text, rows).collect()}

    def gain(rule: Rule) -> float:
        r = found.get(rule.name)
        return r["rejected"] / max(r["seconds"], 1e-9) if r else 0.0

    return sorted(rules, key=gain, reverse=True)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def _judge(rules: list[Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = [i for i, r in enumerate(rules) if r.name in {b.name for b in BASE}]
    names = np.array([r.name for r in rules] + [None], dtype=object)
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            facts = Facts(batch)
            verdict, _ = cascade(batch, rules, facts)
            failed = np.zeros(batch.n_docs, dtype=bool)
            for i in base:
                failed |= rules[i].rejects(facts)
            columns = {"doc_id": rows.column(0).slice(lo, hi - lo)}
            columns |= {k: pa.array(facts[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            columns |= {"base_failed": failed, "kept": (verdict < 0) & ~failed, "rejected_by": pa.array(names[verdict], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)


def quality(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, ``kept`` and the rejecting rule of the cascade.

    ``rules`` in the order given; by default ``RULES`` ordered on a sample.
    """
    chosen = ordered(docs, RULES, text) if rules is None else rules
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(partial(_judge, chosen), OUT)


def _keep(rules: list[Rule], at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows whose text no rule rejects."""
    for rows in batches:
        good = np.concatenate([cascade(batch, rules)[0] < 0 for _, _, batch in TextBatch.pieces(rows.column(at))] or [np.zeros(0, dtype=bool)])
        yield rows.filter(pa.array(good))


def kept(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns; nothing is shuffled."""
    chosen = ordered(docs, RULES, text) if rules is None else rules
    return docs.mapInArrow(partial(_keep, chosen, docs.columns.index(text)), docs.schema)
