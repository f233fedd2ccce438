"""Personal data by patterns and a linear-chain conditional random field.

A text is cut into chains: runs of blank-separated words that hold a digit or ``@`` (or nothing but ``( ) . -``), with one
word of context on either side. No pattern below can match outside a chain, so patterns and the field see chains
only; they are found with numpy, and texts without any cost nothing more.

* Patterns give the base spans.
* The field labels the tokens of a chain (letters, digits, single signs) with B and I of each kind, or O. Its
  features are the shapes of a token, of its neighbours and of its whole word, digit checks and the kind of gap before it.
  It is trained by penalised maximum likelihood (forward-backward in numpy, Adam) on a small labelled table,
  a sample of at most ``TRAIN_CHAINS`` distinct chains of the given rows, labelled by the patterns; a match that
  fails its check is labelled O, so the field learns to tell it apart. Weights go to the tasks; their number is
  bounded by the sample.
* ``decode`` is Viterbi over numpy batches of chains of similar length. A span of the field is added unless it overlaps a
  base span.

Cases: null and empty texts have no spans; repeated rows are each reported; an empty table gives no rows; without any
chain to train on, only patterns count; spans that begin together stand in the order of ``KINDS``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.textbatch import BLANKS, TextBatch

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: distinct chains, tokens of a chain, and steps of training
TRAIN_CHAINS, TRAIN_TOKENS, STEPS = 1_500, 60, 60
PENALTY, RATE = 0.02, 0.15
#: a field's span must be likelier than O by so many nats
MARGIN = 2.0
#: fixed values: base patterns. A digit before an address can't begin another match; an e-mail is looked up from its @
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z\u0080-\U0010FFFF]+|[0-9]+|[^A-Za-z0-9\u0080-\U0010FFFF\x20\x09-\x0D]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1 if start < at else free
        at = text.find("@", max(at + 1, free))
    return out


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of every base match that passes its check."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return out


def _flags(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


TELLING, GLUE = _flags(b"0123456789@"), _flags(b"().-")


@dataclass
class Chains:
    """Chains of a batch: document, first byte and end byte of the chain proper, and with its context."""

    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lefts: np.ndarray
    rights: np.ndarray

    @classmethod
    def of(cls, batch: TextBatch) -> "Chains":
        words = batch.spans(BLANKS)
        n = len(words.starts)
        if not n:
            return cls(*(np.empty(0, np.int64) for _ in range(5)))
        count = lambda table: np.concatenate([[0], np.cumsum(table[batch.data])])
        telling, glue = count(TELLING), count(GLUE)
        tells = telling[words.ends] > telling[words.starts]
        flagged = tells | (glue[words.ends] - glue[words.starts] == words.ends - words.starts)
        same = words.docs[1:] == words.docs[:-1]
        first = flagged & ~np.concatenate([[False], flagged[:-1] & same])
        last = flagged & ~np.concatenate([flagged[1:] & same, [False]])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        told = np.concatenate([[0], np.cumsum(tells)])
        real = told[b + 1] > told[a]
        a, b = a[real], b[real]
        left = np.where((a > 0) & (words.docs[np.maximum(a - 1, 0)] == words.docs[a]), a - 1, a)
        right = np.where((b < n - 1) & (words.docs[np.minimum(b + 1, n - 1)] == words.docs[b]), b + 1, b)
        return cls(words.docs[a], words.starts[a], words.ends[b], words.starts[left], words.ends[right])


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return f"d{min(len(token), 20)}"
    if c.isalpha() or c >= "\x80":
        return ("A" if token.isupper() else "a" if token.islower() else "Aa") + ("1" if len(token) == 1 else "")
    return c


def short_shape(word: str) -> str:
    """Shape of a blank-separated word, runs of letters and digits cut to one sign each."""
    return re.sub(r"[0-9]+", "d", re.sub(r"[A-Za-z\u0080-\U0010FFFF]+", "a", word))[:24]


def features(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Places of the tokens of a chain, and their features."""
    found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    shapes = ["<", "<"] + [shape(t) for _, _, t in found] + [">", ">"]
    words, at = [], 0
    for w in re.finditer(r"[^\x20\x09-\x0D]+", text):
        words.append((w.start(), w.end(), short_shape(w[0]), only_digits(w[0])))
    out = []
    for i, (start, end, token) in enumerate(found):
        while words[at][1] <= start:
            at += 1
        w = words[at]
        gap = "j" if i and found[i - 1][1] == start else "n" if "\n" in text[found[i - 1][1] if i else 0 : start] else "s"
        s = shapes[i + 2]
        own = [
            "1", "s" + s, "p" + shapes[i + 1] + gap, "n" + shapes[i + 3], "q" + shapes[i] + shapes[i + 1], "m" + shapes[i + 3] + shapes[i + 4],
            "t" + shapes[i + 1] + s, "u" + s + shapes[i + 3], "g" + gap + s, "w" + w[2], "x" + w[2] + ("0" if start == w[0] else "1"), "b" + (words[at - 1][2] if at else "<"), "a" + (words[at + 1][2] if at + 1 < len(words) else ">"),
        ]
        if s[0] == "d":
            own.append("v" + str(len(token) <= 3 and int(token) <= 255))
        if "@" in w[2]:
            own.append("@" + ("l" if start < text.index("@", w[0]) else "r"))
        if w[2].startswith("d.d.d.d"):
            own.append("i" + str(all(len(x) <= 3 and int(x) <= 255 for x in re.findall("[0-9]+", text[w[0] : w[1]])[:4])))
        if len(w[3]) >= 14:
            own.append(f"l{len(w[3]) <= 19 and luhn(w[3])}")
        out.append(own)
    return [(a, b) for a, b, _ in found], out


def labelled(text: str, places: list[tuple[int, int]]) -> list[int]:
    """Label numbers of the tokens by the base patterns; of overlapping spans the earlier one counts."""
    out = [0] * len(places)
    for kind, start, end in sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0]))):
        inside = [i for i, (a, b) in enumerate(places) if a >= start and b <= end]
        if inside and not any(out[i] for i in inside):
            b = LABELS.index(f"B-{kind}")
            out[inside[0]] = b
            for i in inside[1:]:
                out[i] = b + 1
    return out


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    numbers: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, len(LABELS)), np.float64))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS)), np.float64))

    def ids(self, chains: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers (chain, token, feature; 0: none) and lengths."""
        length = np.array([len(c) for c in chains])
        wide = max((len(f) for c in chains for f in c), default=1)
        out = np.zeros((len(chains), int(length.max(initial=1)), wide), dtype=np.int64)
        get = self.numbers.get
        for i, chain in enumerate(chains):
            for j, own in enumerate(chain):
                out[i, j, : len(own)] = [get(f, 0) for f in own]
        return out, length

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self.emit[ids].sum(axis=2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(scores: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best label sequence of every chain of a batch (chain, token, label); places beyond a chain's end hold 0."""
    n, t, k = scores.shape
    best, back = scores[:, 0], np.zeros((n, t, k), dtype=np.int64)
    for i in range(1, t):
        step = best[:, :, None] + move[None]
        back[:, i] = step.argmax(axis=1)
        new = step.max(axis=1) + scores[:, i]
        best = np.where((i < length)[:, None], new, best)
    out = np.zeros((n, t), dtype=np.int64)
    state = best.argmax(axis=1)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        live = i < length
        out[live, i] = state[live]
        if i:
            state = np.where(live, back[rows, i, state], state)
    return out


def marginals(scores: np.ndarray, move: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected labels (chain, token, label), expected moves, and the sum of the log normalisers."""
    n, t, k = scores.shape
    ahead, behind = np.zeros((n, t, k)), np.zeros((n, t, k))
    ahead[:, 0] = scores[:, 0]
    for i in range(1, t):
        new = _log_sum(ahead[:, i - 1][:, :, None] + move[None], 1) + scores[:, i]
        ahead[:, i] = np.where((i < length)[:, None], new, ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = _log_sum(move[None] + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where((i + 1 < length)[:, None], new, 0.0)
    norm = _log_sum(ahead[:, -1], 1)
    live = np.arange(t)[None] < length[:, None]
    labels = np.exp(ahead + behind - norm[:, None, None]) * live[:, :, None]
    moves = np.zeros((k, k))
    for i in range(1, t):
        on = i < length
        moves += np.exp(ahead[on, i - 1][:, :, None] + move[None] + (scores[on, i] + behind[on, i])[:, None, :] - norm[on][:, None, None]).sum(axis=0)
    return labels, moves, float(norm.sum())


def spoiled(text: str) -> list[str]:
    """The chain with an address part over 255 or a card digit changed, for every address and card in it."""
    out = []
    for kind, start, end in base_spans(text):
        if kind == "ip":
            part = text[start:end].split(".")
            part[start % 4] = str(256 + (start * 37 + end) % 700)
            out.append(text[:start] + ".".join(part) + text[end:])
        elif kind == "card":
            out.append(text[: end - 1] + str((int(text[end - 1]) + 1 + end % 8) % 10) + text[end:])
    return out


def train(texts: list[str], steps: int = STEPS) -> Field:
    """A field from chains and spoiled ones, labelled by the base patterns."""
    chains, golds = [], []
    for text in texts + [t for x in texts for t in spoiled(x)]:
        places, own = features(text)
        if 0 < len(own) <= TRAIN_TOKENS:
            chains.append(own)
            golds.append(labelled(text, places))
    model = Field()
    if not chains:
        return model
    for f in sorted({f for c in chains for own in c for f in own}):
        model.numbers[f] = len(model.numbers) + 1
    k = len(LABELS)
    ids, length = model.ids(chains)
    gold = np.zeros(ids.shape[:2], dtype=np.int64)
    for i, g in enumerate(golds):
        gold[i, : len(g)] = g
    live = np.arange(ids.shape[1])[None] < length[:, None]
    model.emit, size = np.zeros((len(model.numbers) + 1, k)), len(model.numbers) + 1
    flat = ids[live]
    column = flat.reshape(-1)

    def gathered(values: np.ndarray) -> np.ndarray:
        spread = np.repeat(values, flat.shape[1], axis=0)
        return np.stack([np.bincount(column, spread[:, j], minlength=size) for j in range(k)], axis=1)

    right = np.eye(k)[gold[live]]
    right_moves = np.zeros((k, k))
    for g in golds:
        np.add.at(right_moves, (g[:-1], g[1:]), 1)
    want = gathered(right)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.emit, model.move)]
    for step in range(1, steps + 1):
        labels, moves, _ = marginals(model.scores(ids), model.move, length)
        slopes = (gathered(labels[live]) - want + PENALTY * model.emit, moves - right_moves + PENALTY * model.move)
        for x, slope, (m, v) in zip((model.emit, model.move), slopes, state):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.emit[0] = 0
    return model


def decode(model: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each chain."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    told = [features(t) for t in texts]
    order = sorted((i for i in range(len(texts)) if told[i][0]), key=lambda i: len(told[i][0]))
    at = 0
    while at < len(order):
        # a batch's chains are of similar length, its cells bounded
        most = max(1, min(2048, 200_000 // max(1, len(told[order[min(at + 2047, len(order) - 1)]][0]))))
        part = order[at : at + most]
        at += most
        ids, length = model.ids([told[i][1] for i in part])
        scores = model.scores(ids)
        for i, path, score in zip(part, viterbi(scores, model.move, length), scores):
            places, j = told[i][0], 0
            while j < len(places):
                label = path[j]
                if label and LABELS[label][0] == "B":
                    end = j + 1
                    while end < len(places) and path[end] == label + 1:
                        end += 1
                    gain = sum(score[x, path[x]] - score[x, 0] for x in range(j, end))
                    if gain >= MARGIN:
                        out[i].append((LABELS[label][2:], places[j][0], places[end - 1][1]))
                    j = end
                else:
                    j += 1
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for _, _, batch in TextBatch.pieces(rows.column(0)):
            c = Chains.of(batch)
            short = c.rights - c.lefts <= 400
            yield pa.RecordBatch.from_pydict({"chain": [batch.data[a:b].tobytes().decode() for a, b in zip(c.lefts[short], c.rights[short])]}, schema=pa.schema([("chain", pa.string())]))


def training_chains(docs: DataFrame, text: str = "text", most: int = TRAIN_CHAINS) -> list[str]:
    """At most ``most`` distinct chains, picked by hash over all rows."""
    found = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).mapInArrow(_chains, "chain string")
    return [r["chain"] for r in found.distinct().orderBy(F.xxhash64("chain"), "chain").limit(most).collect()]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(model: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            chains = Chains.of(batch)
            before = np.concatenate([[0], np.cumsum(batch.character_starts)])
            offset = before[chains.lefts] - before[batch.offsets[:-1][chains.docs]]
            texts = [batch.data[a:b].tobytes().decode() for a, b in zip(chains.lefts, chains.rights)]
            base: list[list] = [[] for _ in range(batch.n_docs)]
            more: list[list] = [[] for _ in range(batch.n_docs)]
            guessed = decode(model, texts) if model.numbers else [[] for _ in texts]
            for i, text in enumerate(texts):
                doc, at = chains.docs[i], int(offset[i])
                skip = int(before[chains.starts[i]] - before[chains.lefts[i]])
                stop = int(before[chains.ends[i]] - before[chains.lefts[i]])
                own = [(k, a + skip, b + skip) for k, a, b in base_spans(text[skip:stop])]
                base[doc] += [(k, a + at, b + at) for k, a, b in own]
                more[doc] += [(k, a + at, b + at) for k, a, b in guessed[i] if not any(a < y and x < b for _, x, y in own)]
            counts = [[sum(s[0] == k for s in spans) for spans in base] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(told(b).encode()).hexdigest() if b else nothing for b in base]),
                    pa.array([told(b + [s for s in dict.fromkeys(m) if s not in b]) for b, m in zip(base, more)], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Field | None = None) -> DataFrame:
    """Counts and hash of the base spans and all spans of every row; the field is trained on these rows unless given."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = model or train(training_chains(docs))
    return docs.mapInArrow(partial(_find, model), OUT)
