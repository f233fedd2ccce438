"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A passage is a window of
``2 * HALF`` words, one beginning every ``HALF`` words, so that it holds half a benchmark item or more
wherever the item stands. The terms are the words of the benchmark. A term's weight is its count times its
inverse document frequency to the power ``IDF_POWER``: invented or rare words tell passages apart better than common ones.

1. Document frequencies of the terms are counted over all documents.
2. ``fit``: SVD of the unit-length TF-IDF passages of all benchmark items and of all documents. For spaces of up to ``GRAM_TERMS``
   terms the terms' products over all passages are summed in one pass (a task gives out a triangle of terms x terms, whatever number of
   rows it has), and the driver takes their eigenvectors. For a larger space, of one long item, it is randomised: tasks multiply their rows
   with a random matrix and back, and the driver makes the sums orthogonal and takes the last, small eigenvectors.
3. Every passage of every document is projected and compared with every item window. The cosine counts words
   that are no terms (with the median weight) in the passage's length, and is divided by the share of the window's length that the latent
   space keeps (at least ``KEPT``), so that an equal passage gets about 1.
4. Pairs of at least ``COSINE`` are checked on the words: longest common subsequence of the item and the
   document's words round the passage. ``COPY`` of the item's words or more is a copy. From ``PARAPHRASE``
   on it is a paraphrase, if as large a share of the item's content words (in under ``COMMON`` of the documents)
   and ``ANSWER`` of the answer's words stand there in order as well.
   The answer is the column ``answer``, or the last ``ANSWER_WORDS`` words of the item.
5. ``DIMENSIONS`` hold few items whole, so the benchmark is cut into latent spaces of ``GROUP_ITEMS`` items, all searched in one pass
   over the documents: what a space keeps of an item doesn't fall as the benchmark grows. Copies of items under ``SHORT`` words,
   which heavy words beside them can hide, are looked up exactly as well, and so are all matches of items of which a space keeps less than ``KEPT``
   in every window: a match leaves so many of the item's rare words (content words, or the
   rarest ``COPY`` of all if those are under half) near one passage that postings of these words propose all places. The same
   checks follow, with the cosine of the whole rows in place of the latent one; a copy whose words stand within
   ``1 / COPY`` times the item's length needs no cosine.

The benchmark is the query set: up to ``BLOCK_ITEMS`` items meet all documents at once.

Cases: null ids of documents and items are ids like others, and of several texts under one id ``clean`` drops those that
hold an item; null and empty texts or items match nothing; items of fewer than ``LEAST_WORDS`` words are too short to
tell and match nothing; repeated rows give repeated matches; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import Terms, document_frequencies, words_of
from marginalia.llm.textbatch import Spans, TextBatch

HALF = 16
COSINE = 0.45
KEPT = 0.3
IDF_POWER = 1.5
COMMON = 0.1
COPY = 0.75
PARAPHRASE = 0.5
ANSWER = 0.6
ANSWER_WORDS = 5
#: an item of fewer words can be under half of a passage's weight
SHORT = 20
LEAST_WORDS = 5
#: latent dimensions, and further ones of the random matrix
DIMENSIONS, FURTHER = 64, 16
#: terms whose products are summed in one pass, and rows of these sums that travel together
GRAM_TERMS, BAND_ROWS = 4_096, 128
#: weight of the documents' passages against that of the items' in the decomposition
DOC_SHARE = 0.1
#: items and characters of one latent space
GROUP_ITEMS, GROUP_CHARS = 64, 32_000
#: items and characters of the benchmark that one pass over the documents takes
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 4_000_000
#: postings that are looked up at once (about)
LOOKED_UP = 1 << 17


@dataclass
class Passages:
    """Windows of a batch: document and first half of each, and the halves' first words."""

    docs: np.ndarray
    halves: np.ndarray
    paired: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, words: Spans) -> "Passages":
        per_doc = -(-words.counts // HALF)
        first_half = np.concatenate([[0], np.cumsum(per_doc)])
        half_doc = np.repeat(np.arange(words.n_docs), per_doc)
        starts = words.firsts[half_doc] + (np.arange(first_half[-1]) - first_half[half_doc]) * HALF
        is_last = np.arange(first_half[-1]) == first_half[half_doc + 1] - 1
        alone = is_last & (per_doc[half_doc] == 1)
        halves = np.flatnonzero(~is_last | alone)
        return cls(half_doc[halves], halves, ~alone[halves], starts, np.minimum(starts + HALF, words.firsts[half_doc + 1]))

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the words' rows in each window."""
        return self._windows(np.add.reduceat(rows, self.starts, axis=0))

    def looked_up(self, numbers: np.ndarray, rows: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Sum of the rows that the words' numbers name in each window (of ``some``); the last row is that of no number."""
        first, paired = (self.halves, self.paired) if some is None else (self.halves[some], self.paired[some])
        wanted = np.zeros(len(self.starts), dtype=bool)
        wanted[first] = True
        wanted[first[paired] + 1] = True
        place = np.cumsum(wanted) - 1
        starts, ends = self.starts[wanted], self.ends[wanted]
        halves = np.zeros((len(starts), rows.shape[1]), rows.dtype)
        for j in range(HALF):
            own = starts + j
            halves += rows[np.where(own < ends, numbers[np.minimum(own, len(numbers) - 1)], -1)]
        out = halves[place[first]]
        out[paired] += halves[place[first[paired] + 1]]
        return out

    def repeats(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a known word that stands again in a window, and the window, for each such pair of places."""
        known = np.flatnonzero(numbers >= 0)
        number, half = numbers[known], np.repeat(np.arange(len(self.starts)), self.ends - self.starts)[known]
        begun = np.full(len(self.starts) + 1, -1)
        begun[self.halves] = np.arange(len(self.halves))
        paired = np.append(self.paired, False)
        words, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for far in range(1, min(2 * HALF, len(known))):
            at = np.flatnonzero(number[:-far] == number[far:])
            apart = half[at + far] - half[at]
            same, next_half = at[apart == 0], at[apart == 1]
            # the window that begins with the word's half, and the one before if that has it as its second half
            before = begun[half[same] - 1]
            before[~paired[before]] = -1
            across = begun[half[next_half]]
            across[~paired[across]] = -1
            for place, window in ((same, begun[half[same]]), (same, before), (next_half, across)):
                words.append(known[place[window >= 0]])
                windows.append(window[window >= 0])
        return np.concatenate(words), np.concatenate(windows)

    def _windows(self, halves: np.ndarray) -> np.ndarray:
        out = halves[self.halves]
        out[self.paired] += halves[self.halves[self.paired] + 1]
        return out


def passage_matrix(batch: TextBatch, terms: Terms, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """TF-IDF rows of the batch's passages, multiplied with ``rows`` (a row for each term)."""
    words = words_of(batch)
    if not len(words.starts):
        return np.zeros((0, rows.shape[1]), dtype=np.float32)
    weighted = np.vstack([(rows * weight[:, None]).astype(np.float32), np.zeros((1, rows.shape[1]), np.float32)])
    return Passages.of(words).looked_up(terms.numbers(words.hashes), weighted)


def _back(batch: TextBatch, terms: Terms, weight: np.ndarray, projected: np.ndarray) -> np.ndarray:
    """Transposed TF-IDF matrix of the passages, multiplied with a row for each passage."""
    words = words_of(batch)
    p = Passages.of(words)
    halves = np.zeros((len(p.starts), projected.shape[1]))
    np.add.at(halves, p.halves, projected)
    np.add.at(halves, p.halves[p.paired] + 1, projected[p.paired])
    number = terms.numbers(words.hashes)
    half_of_word = np.searchsorted(p.starts, np.arange(len(words.starts)), side="right") - 1
    out = np.zeros((terms.size, projected.shape[1]))
    known = number >= 0
    np.add.at(out, number[known], halves[half_of_word[known]])
    return out * weight[:, None]


def passage_lengths(batch: TextBatch, terms: Terms, weight: np.ndarray) -> np.ndarray:
    """Length of each passage's row, a word counted once for each place; ``weight`` has that of other words at its end."""
    words = words_of(batch)
    if not len(words.starts):
        return np.zeros((0, 1))
    return np.maximum(np.sqrt(Passages.of(words).sums((weight[terms.numbers(words.hashes)] ** 2)[:, None])), 1e-6)


def product(batch: TextBatch, terms: Terms, weight: np.ndarray, rows: np.ndarray, gram: bool) -> tuple[int, np.ndarray]:
    """Passages, and over their unit-length rows: transposed matrix times matrix times ``rows``, or the outer products of the projected rows."""
    lengths = passage_lengths(batch, terms, weight)
    projected = passage_matrix(batch, terms, weight[:-1], rows).astype(np.float64) / lengths
    return len(projected), projected.T @ projected if gram else _back(batch, terms, weight[:-1], projected / lengths)


@dataclass
class Group:
    """Items of one latent space: texts, terms, the terms' weights (and that of other words at the end) and document frequencies."""

    ids: list[int]
    texts: list[str]
    answers: list[str | None]
    terms: Terms
    weight: np.ndarray
    df: np.ndarray


def _products(groups: list[Group], rows: list[np.ndarray], gram: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``product`` over the texts; one array a task and group."""
    totals = [np.zeros((r.shape[1] if gram else len(r), r.shape[1])) for r in rows]
    n = [0] * len(groups)
    for part in batches:
        for _, _, batch in TextBatch.pieces(part.column(0)):
            for i, g in enumerate(groups):
                found, summed = product(batch, g.terms, g.weight, rows[i], gram)
                n[i] += found
                totals[i] += summed
    yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(groups)), pa.int32()), "n": n, "total": [t.tobytes() for t in totals]})


class Gram:
    """Sums over passages of the products of two terms in their unit-length rows; ``total`` has them without the terms' weights, a pair of words once."""

    def __init__(self, terms: Terms, weight: np.ndarray):
        self.terms, self.weight, self.n, self.size = terms, weight, 0, terms.size
        self.total = np.zeros(self.size**2)

    def add(self, words: Spans, p: Passages) -> None:
        """The passages of these texts."""
        self.n += len(p.docs)
        number = self.terms.numbers(words.hashes)
        weight = self.weight[number]
        # a row's length is that of ``passage_lengths``; a half is in the passage that it begins and in the one before
        begun = np.zeros(len(p.starts))
        begun[p.halves] = 1 / np.maximum(p.sums((weight**2)[:, None])[:, 0], 1e-12)
        alone, both = begun.copy(), np.zeros(len(p.starts))
        alone[p.halves[p.paired] + 1] += begun[p.halves[p.paired]]
        both[p.halves[p.paired]] = begun[p.halves[p.paired]]
        known = np.flatnonzero(number >= 0)
        half = np.repeat(np.arange(len(p.starts), dtype=np.int32), p.ends - p.starts)[known]
        number, alone, both = number[known].astype(np.int32), alone[half], both[half]
        row = number * np.int32(self.size)
        self._put(row + number, alone / 2)
        # the first known words behind a word's half and behind the next half
        here, there = (np.searchsorted(half, half + k, side="right").astype(np.int32) for k in (0, 1))
        same = apart = np.arange(len(known), dtype=np.int32)
        far = 0
        while len(apart):
            # words with a word so many known ones later in their own half, and in it or the next
            far += 1
            same, apart = same[here[same] - same > far], apart[there[apart] - apart > far]
            self._put(row[same] + number[same + far], alone[same])
            split = apart[here[apart] - apart <= far]
            self._put(row[split] + number[split + far], both[split])

    def _put(self, at: np.ndarray, value: np.ndarray) -> None:
        np.add.at(self.total, at, value)

    def products(self, of: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """With the terms' weights, the sums of the terms ``of``: their rows from ``lo`` to ``hi``, from column ``lo`` on."""
        one_way, rows, columns = self.total.reshape(self.size, self.size), of[lo:hi], of[lo:]
        both = one_way[np.ix_(rows, columns)] + one_way[np.ix_(columns, rows)].T
        return both * self.weight[rows, None] * self.weight[columns]


def _gram(terms: Terms, weight: np.ndarray, spaces: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of each space's terms, in bands of rows from the diagonal on; terms of different spaces are not needed together."""
    gram = Gram(terms, weight)
    for part in batches:
        for _, _, batch in TextBatch.pieces(part.column(0)):
            words = words_of(batch)
            if len(words.starts):
                gram.add(words, Passages.of(words))
    for i, of in enumerate(spaces if gram.n else []):
        for band in range(0, len(of), BAND_ROWS):
            total = gram.products(of, band, band + BAND_ROWS).tobytes()
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "band": pa.array([band], pa.int32()), "n": pa.array([gram.n], pa.int64()), "total": pa.array([total], pa.binary())})


def _added(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _leading(split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    values, vectors = split
    return vectors[:, np.argsort(values)[::-1][:DIMENSIONS]]


def _fit_exactly(texts: DataFrame, groups: list[Group]) -> list[np.ndarray]:
    """``fit`` by the sums of all products of the groups' terms; a word that is a term of another of the groups has its own weight in a text's length."""
    hashes, at = np.unique(np.concatenate([g.terms.hashes for g in groups]), return_index=True)
    terms = Terms(hashes)
    weight = np.append(np.concatenate([g.weight[:-1] for g in groups])[at], groups[0].weight[-1])
    spaces = [terms.numbers(g.terms.hashes) for g in groups]
    # as many sums as there are tasks at a time, not as there are splits
    few = texts.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism))
    parts = few.mapInArrow(partial(_gram, terms, weight, spaces), "at int, band int, n long, total binary").rdd
    sums = [np.zeros((g.terms.size, g.terms.size)) for g in groups]
    # a task adds up one band after another, and the driver gets each band once, those of one task at a time
    for (i, band), (n, total) in parts.map(lambda r: ((r["at"], r["band"]), (r["n"], np.frombuffer(r["total"])))).reduceByKey(_added).toLocalIterator():
        rows = sums[i][band : band + BAND_ROWS, band:]
        rows += DOC_SHARE / n * total.reshape(rows.shape)
    out = []
    for g, whole in zip(groups, sums):
        own = Gram(g.terms, g.weight)
        words = words_of(TextBatch.of(g.texts))
        own.add(words, Passages.of(words))
        whole += own.products(np.arange(own.size), 0, own.size) / max(own.n, 1)
        # the rows have their columns from the diagonal on
        out.append(_leading(np.linalg.eigh(whole, UPLO="U")))
    return out


def fit(texts: DataFrame, groups: list[Group], text: str = "text") -> list[np.ndarray]:
    """For each group the leading right singular vectors (terms x dimensions) of the unit-length passages of ``texts`` and of its items."""
    texts = texts.select(text)
    found: dict[int, np.ndarray] = {}
    runs: list[tuple[list[int], np.ndarray]] = []
    for i, g in enumerate(groups):
        if g.terms.size > GRAM_TERMS:
            found[i] = _fit_randomly(texts, [g])[0]
            continue
        hashes = np.union1d(runs[-1][1], g.terms.hashes) if runs else g.terms.hashes
        if runs and len(hashes) <= GRAM_TERMS:
            runs[-1] = ([*runs[-1][0], i], hashes)
        else:
            runs.append(([i], g.terms.hashes))
    for run, _ in runs:
        found.update(zip(run, _fit_exactly(texts, [groups[i] for i in run])))
    return [found[i] for i in range(len(groups))]


def _fit_randomly(texts: DataFrame, groups: list[Group]) -> list[np.ndarray]:
    """``fit`` by random projections, in three passes; memory does not grow with the square of the terms."""
    rng = np.random.default_rng(11)
    rows = [rng.standard_normal((g.terms.size, min(DIMENSIONS + FURTHER, g.terms.size))) for g in groups]
    own = [TextBatch.of(g.texts) for g in groups]

    def both(gram: bool) -> list[np.ndarray]:
        parts = texts.mapInArrow(partial(_products, groups, rows, gram), "at int, n long, total binary").collect()
        out = []
        for i, g in enumerate(groups):
            mine, summed = product(own[i], g.terms, g.weight, rows[i], gram)
            theirs = sum((np.frombuffer(p["total"]).reshape(summed.shape) for p in parts if p["at"] == i), np.zeros(summed.shape))
            out.append(summed / max(mine, 1) + DOC_SHARE * theirs / max(sum(p["n"] for p in parts if p["at"] == i), 1))
        return out

    for _ in range(2):
        rows = [np.linalg.qr(m)[0] for m in both(False)]
    return [r @ _leading(np.linalg.eigh(m)) for r, m in zip(rows, both(True))]


@dataclass
class Item:
    """Words of an item; lengths and bit masks of the positions of its words, its content words and its answer."""

    words: np.ndarray
    length: int
    masks: dict[int, int]
    content_length: int
    content_masks: dict[int, int]
    answer_length: int
    answer_masks: dict[int, int]


def masks_of(numbers: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, number in enumerate(numbers):
        out[number] = out.get(number, 0) | 1 << i
    return out


def common(masks: dict[int, int], length: int, numbers: list[int]) -> int:
    """Length of the longest common subsequence, by bits: a zero of ``row`` is a matched position."""
    full = (1 << length) - 1
    row = full
    for number in numbers:
        mask = masks.get(number)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


@dataclass
class Postings:
    """Rare words of the items: items by term, and for each item the words wanted near a passage and the width of that place."""

    firsts: np.ndarray
    items: np.ndarray
    rare: list[np.ndarray]
    least: np.ndarray
    width: np.ndarray


def postings_of(items: list[Item], df: np.ndarray, lost: np.ndarray | None = None) -> Postings:
    """Postings of the items ``lost`` to the latent search (None: of all), and for their copies of those shorter than ``SHORT``."""
    rare, least = [], []
    for at, item in enumerate(items):
        n, own = item.length, np.argsort(df[item.words], kind="stable")
        few = 2 * item.content_length < n
        k = math.ceil(COPY * n) if few else item.content_length
        # words of a copy or a paraphrase that may be missing
        copy = k - (n - math.ceil(COPY * n))
        paraphrase = k - (n - math.ceil(PARAPHRASE * n)) if few else math.ceil(PARAPHRASE * k)
        rare.append(np.unique(item.words[own[:k]]) if n >= LEAST_WORDS and (lost is None or lost[at] or n < SHORT) else np.empty(0, np.int64))
        least.append(max(1, min(copy, paraphrase) if lost is None or lost[at] else copy))
    term = np.concatenate([*rare, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(items)), [len(x) for x in rare])
    firsts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
    # a copy that needs no cosine stands close together
    width = [2 * x.length + 2 * HALF if lost is None or lost[at] else math.ceil(max(x.length, 1) / COPY) for at, x in enumerate(items)]
    return Postings(firsts, of[np.argsort(term, kind="stable")], rare, np.array(least, np.int64), np.array(width, np.int64))


def looked_up(postings: Postings, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, first word, end) of every stretch with enough of an item's rare words; each place of a match lies in one of them."""
    known = np.flatnonzero(numbers >= 0)
    n = np.diff(postings.firsts)[numbers[known]]
    known, n = known[n > 0], n[n > 0]
    before = np.concatenate([[0], np.cumsum(n)])
    overlap = 2 * int(postings.width.max(initial=1))
    seen: set[tuple[int, int]] = set()
    lo = 0
    while lo < len(known):
        # a range of words is more than twice as wide as what it has in common with the next
        hi = max(int(np.searchsorted(before, before[lo] + LOOKED_UP, side="right")) - 1, int(np.searchsorted(known, known[lo] + 3 * overlap)))
        at, times = known[lo:hi], n[lo:hi]
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(postings.firsts[numbers[at]], times)
        item = postings.items[slot].astype(np.int64)
        keys, counts = np.unique(item << 40 | np.repeat(at, times) // postings.width[item], return_counts=True)
        both = counts.copy()
        follows = np.flatnonzero(np.diff(keys) == 1)
        both[follows] += counts[follows + 1]
        for key in keys[both >= postings.least[keys >> 40]].tolist():
            i, cell = key >> 40, key & (1 << 40) - 1
            if (i, cell) not in seen:
                seen.add((i, cell))
                yield i, cell * int(postings.width[i]), (cell + 2) * int(postings.width[i])
        lo = hi if hi >= len(known) else int(np.searchsorted(known, known[hi] - overlap))


def whole_cosine(passage: np.ndarray, item: np.ndarray, squares: np.ndarray) -> float:
    """Largest cosine of a passage with the item's windows over all terms, lengths as in ``passage_lengths``."""
    best = 0.0
    for at in range(0, max(-(-len(item) // HALF) - 1, 1) * HALF, HALF):
        window = item[at : at + 2 * HALF]
        dot = squares[passage] @ (passage[:, None] == window[None, :]).sum(axis=1)
        best = max(best, float(dot / math.sqrt(max(float(squares[passage].sum() * squares[window].sum()), 1e-12))))
    return min(best, 1.0)


def tight(item: Item, near: list[int]) -> bool:
    """Whether ``COPY`` of the item's words stand in order within ``1 / COPY`` times its length."""
    size = math.ceil(item.length / COPY)
    return any(common(item.masks, item.length, near[at : at + size]) >= COPY * item.length for at, number in enumerate(near) if number in item.masks)


def held(item: Item, near: list[int]) -> tuple[int, int] | None:
    """Words in common and words of the answer, if they are a copy or a paraphrase."""
    found = common(item.masks, item.length, near)
    if found < PARAPHRASE * item.length:
        return None
    answer = common(item.answer_masks, item.answer_length, near)
    rare = common(item.content_masks, item.content_length, near)
    if found < COPY * item.length and (answer < ANSWER * item.answer_length or rare < PARAPHRASE * item.content_length):
        return None
    return found, answer


@dataclass
class Index:
    """What a task needs to search: bounded by the benchmark block."""

    ids: list[int]
    items: list[Item]
    own: np.ndarray
    rows: np.ndarray
    squares: np.ndarray
    windows: np.ndarray
    window_item: np.ndarray
    postings: Postings


def index_of(group: Group, block: Terms, n_docs: int, vectors: np.ndarray) -> Index:
    """``vectors``: the group's latent space; ``block``: terms of all groups; ``n_docs``: documents among which its frequencies were counted."""
    ids, texts, answers, terms, weight, df = group.ids, group.texts, group.answers, group.terms, group.weight, group.df
    content = df < COMMON * n_docs
    batch = TextBatch.of(texts)
    words = words_of(batch)
    number = terms.numbers(words.hashes)
    items = []
    for i in range(len(texts)):
        own_words = number[words.firsts[i] : words.firsts[i + 1]]
        own = own_words.tolist()
        given = words_of(TextBatch.of([answers[i]])) if answers[i] else None
        answer = terms.numbers(given.hashes).tolist() if given is not None else own[-ANSWER_WORDS:]
        rare = [x for x in own if content[x]]
        items.append(Item(own_words, len(own), masks_of(own), len(rare), masks_of(rare), len(answer), masks_of(answer)))
    windows = passage_matrix(batch, terms, weight[:-1], vectors).astype(np.float64)
    lengths = np.linalg.norm(windows, axis=1, keepdims=True)
    whole = np.maximum(lengths, passage_lengths(batch, terms, weight))
    windows /= np.maximum(lengths * np.maximum(lengths / whole, KEPT), 1e-12)
    window_item = Passages.of(words).docs
    lost = np.ones(len(items), dtype=bool)
    lost[window_item[lengths[:, 0] >= KEPT * whole[:, 0]]] = False
    rows = np.vstack([vectors * weight[:-1, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    # the group's number of each of the block's terms; the last one is that of no term
    own = np.append(terms.numbers(block.hashes), np.int32(-1))
    return Index(ids, items, own, rows, (weight**2).astype(np.float32), windows.astype(np.float32), window_item, postings_of(items, df, lost))


def _search(terms: Terms, indexes: list[Index], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            words = words_of(batch)
            if not len(words.starts):
                continue
            passages = Passages.of(words)
            known = terms.numbers(words.hashes)
            repeats = passages.repeats(known)
            for index in indexes:
                numbers = index.own[known]
                best = _found(index, words, numbers, passages, repeats)
                if best:
                    keys, values = list(best), list(best.values())
                    yield pa.RecordBatch.from_pydict({
                        **{name: rows.column(c).slice(lo, hi - lo).take(pa.array([d for d, _ in keys])) for name, c in (("doc_id", 0), ("mark", 2))}, "item_id": pa.array([index.ids[i] for _, i in keys], pa.int64()),
                        "cosine": [round(v[1], 4) for v in values], "common_words": pa.array([v[0] for v in values], pa.int64()), "item_words": pa.array([index.items[i].length for _, i in keys], pa.int64()),
                        "answer_words": pa.array([v[2] for v in values], pa.int64()), "kind": ["copy" if v[0] >= COPY * index.items[i].length else "paraphrase" for (_, i), v in zip(keys, values)],
                    })


def _reaching(index: Index, numbers: np.ndarray, passages: Passages, lengths: np.ndarray, repeats: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Passages whose terms have weight enough for ``COSINE``: a projected row is no longer than the row, and no window longer than the longest."""
    squares = np.append(index.squares[:-1], 0)[numbers].astype(np.float64)
    words, windows = repeats
    # the square of a term's count: its places, and twice the pairs of them
    whole = passages.sums(squares[:, None])[:, 0] + 2 * np.bincount(windows, squares[words], minlength=len(lengths))
    longest = np.linalg.norm(index.windows, axis=1).max(initial=0)
    return np.flatnonzero(np.sqrt(whole) * longest >= (COSINE - 1e-3) * np.maximum(lengths[:, 0], 1e-6))


def _found(index: Index, words: Spans, numbers: np.ndarray, passages: Passages, repeats: tuple[np.ndarray, np.ndarray]) -> dict[tuple[int, int], tuple[int, float, int]]:
    """Words in common, cosine and words of the answer by (document, item)."""
    best: dict[tuple[int, int], tuple[int, float, int]] = {}
    lengths = np.sqrt(passages.sums(index.squares[numbers][:, None]))
    some = _reaching(index, numbers, passages, lengths, repeats)
    vectors = passages.looked_up(numbers, index.rows, some)
    vectors /= np.maximum(np.maximum(lengths[some], np.linalg.norm(vectors, axis=1, keepdims=True)), 1e-6)
    firsts = passages.starts[passages.halves]
    for at in range(0, len(vectors), 4096):
        cosine = vectors[at : at + 4096] @ index.windows.T
        for p, w in zip(*np.nonzero(cosine >= COSINE)):
            passage = some[at + p]
            doc, i = int(passages.docs[passage]), int(index.window_item[w])
            item = index.items[i]
            if item.length < LEAST_WORDS:
                continue
            start = int(firsts[passage])
            near = numbers[max(start - item.length, words.firsts[doc]) : min(start + 2 * HALF + item.length, words.firsts[doc + 1])].tolist()
            both = held(item, near)
            if both is None:
                continue
            new = (both[0], float(cosine[p, w]), both[1])
            best[doc, i] = max(best.get((doc, i), new), new)
    tables: dict[int, np.ndarray] = {}
    for i, lo, hi in looked_up(index.postings, numbers):
        item = index.items[i]
        if i not in tables:
            tables[i] = np.zeros(len(index.rows), dtype=bool)
            tables[i][index.postings.rare[i]] = True
        hits = np.concatenate([[0], np.cumsum(tables[i][numbers[lo:hi]])])
        own = np.arange(*np.searchsorted(firsts, [lo - item.length - 2 * HALF, hi + item.length]))
        first = np.maximum(firsts[own] - item.length, words.firsts[passages.docs[own]])
        end = np.minimum(firsts[own] + 2 * HALF + item.length, words.firsts[passages.docs[own] + 1])
        last = len(hits) - 1
        enough = hits[np.minimum(np.maximum(end - lo, 0), last)] - hits[np.minimum(np.maximum(first - lo, 0), last)] >= index.postings.least[i]
        for p, a, b in zip(own[enough].tolist(), first[enough].tolist(), end[enough].tolist()):
            doc, start = int(passages.docs[p]), int(firsts[p])
            near = numbers[a:b].tolist()
            both = held(item, near)
            if both is None or (both[0], 2.0) <= best.get((doc, i), (0, 0.0)):
                continue
            whole = whole_cosine(numbers[start : min(start + 2 * HALF, words.firsts[doc + 1])], item.words, index.squares)
            if whole >= COSINE or (both[0] >= COPY * item.length and tight(item, near)):
                new = (both[0], whole, both[1])
                best[doc, i] = max(best.get((doc, i), new), new)
    return best


MATCHES = "doc_id long, mark long, item_id long, cosine double, common_words long, item_words long, answer_words long, kind string"


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return marked(docs, benchmark, key, text, item_key, item_text).drop("mark")


def marked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``matches`` with ``mark``, which tells the texts of one id apart."""
    whole = F.col(text).cast("string")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("mark"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), answer.alias("answer")).where("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    n_docs = docs.count()
    out = None
    for block in range(blocks):
        own = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        texts = [r["text"] for r in own]
        terms = Terms(words_of(TextBatch.of(texts + [r["answer"] or "" for r in own])).hashes) if own else None
        if terms is None or not terms.size:
            continue
        df = document_frequencies(docs, terms)
        weight = (np.log((n_docs + 1) / (df + 1)) + 0.01) ** IDF_POWER
        # a word that is no term weighs as the middle word of the benchmark does
        middle = np.median(weight[terms.numbers(words_of(TextBatch.of(texts)).hashes)])
        groups = groups_of(own, terms, weight, df, middle)
        indexes = [index_of(g, terms, n_docs, vectors) for g, vectors in zip(groups, fit(docs, groups))]
        found = docs.mapInArrow(partial(_search, terms, indexes), MATCHES)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def groups_of(items: list, terms: Terms, weight: np.ndarray, df: np.ndarray, middle: float) -> list[Group]:
    """Items in runs of ``GROUP_ITEMS`` and ``GROUP_CHARS`` at most (a longer item is a run by itself)."""
    runs: list[list] = []
    chars = 0
    for item in items:
        if not runs or len(runs[-1]) >= GROUP_ITEMS or chars + len(item["text"]) > GROUP_CHARS:
            runs.append([])
            chars = 0
        runs[-1].append(item)
        chars += len(item["text"])
    out = []
    for run in runs:
        hashes = words_of(TextBatch.of([r["text"] for r in run] + [r["answer"] or "" for r in run])).hashes
        if not len(hashes):
            continue
        own = Terms(hashes, bits=max(10, len(hashes).bit_length() + 2))
        at = terms.numbers(own.hashes)
        out.append(Group([r["item_id"] for r in run], [r["text"] for r in run], [r["answer"] for r in run], own, np.append(weight[at], middle), df[at]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whole and with their columns."""
    leaks = marked(docs, benchmark, key, text).select(F.col("doc_id").alias("leaked_id"), F.col("mark").alias("leaked_mark")).distinct()
    return docs.join(leaks, docs[key].cast("long").eqNullSafe(leaks["leaked_id"]) & (F.xxhash64(F.col(text).cast("string")) == leaks["leaked_mark"]), "left_anti")
