"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

A text is read as a line of letters, lower-cased one by one; every run of other characters is one blank, and a text begins with blanks.
``ORDER`` characters of 16 bits (letters beyond the first plane are folded into it) make a 64-bit key without loss.

1. Tasks count the keys of every whole training text by language; the counts are added up as a table that grows with the
   corpus. Counts of shorter keys are continuation counts: of how many longer keys a key is the end.
2. A key's share is ``(count - D) / total of its context`` with ``D = n1 / (n1 + 2 * n2)`` of its order; what the discounts of a
   context's keys come to is its back-off weight. All keys count. While the joint table of all keys has at most ``CELLS`` cells it is sent to
   the tasks. A larger one stays a table (``Tabled``): the distinct keys of the texts are looked up by joins, to the same probabilities.
3. The joint model is an array of sorted hashes for each order (the hash is a bijection, so no two keys share one), found through an
   index of its leading bits, with the log probability of each key in every language; contexts likewise.
4. A text's cross-entropy in a language is the mean negative log probability of its characters; the least one names the language.
5. Calibration: models of two of the three training folds judge a sample of about ``SAMPLE_DOCS`` documents of the third. A
   logistic function of the lead over the second best, its root-length weighted form and the text's length gives ``score``, the chance that
   the prediction is right. A text is accepted if ``score`` is ``ACCEPT`` or more and its cross-entropy lies at most ``limit``
   deviations (the ``1 - REJECTED`` quantile of the sample's right ones) above its language's mean.

Cases: null ids count as the text '' in the split, and are learned from; null texts and texts without a letter are ``und``,
score 0, not accepted; languages are compared as they are written (an empty string is one); repeated rows are
learned and judged as often as they occur; a tie goes to the first language in alphabetical order; without a training
text all are ``und``; a single language is the answer for all texts with a letter; an empty table gives no rows.
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

from marginalia.llm.textbatch import TextBatch, mix
from marginalia.session import written

ORDER = 4
#: cells (keys x languages) of a joint model
CELLS = 1 << 24
#: documents that calibrate
SAMPLE_DOCS = 4_000
ACCEPT = 0.5
REJECTED = 0.005
#: probability of a letter that no language has seen is spread over so many
ALPHABET = 1 << 16
#: counted keys that a task holds before it hands them on
HELD = 1 << 20
_BITS = 16


def _classes() -> np.ndarray:
    """Character class of every code point: 0 for what is no letter, else its lower-case form folded into 16 bits."""
    codes = np.zeros(0x110000, dtype=np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            code = ord(low) if len(low) == 1 else c
            codes[c] = code if code < 1 << 16 else 1 + code % 65535
    return codes


_table: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _table:
        _table.append(_classes())
    return _table[0]


def keys_of(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and document of every character of the texts' lines of letters; and for each text whether it has a letter."""
    codes = np.frombuffer(batch.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum(batch.character_starts)])
    firsts = before[batch.offsets]
    letters = classes()[codes]
    # a text's own line end is a blank; the next text begins anew
    first = np.zeros(len(codes), dtype=bool)
    first[firsts[:-1]] = True
    keep = letters != 0
    keep[1:] |= (letters[:-1] != 0) & ~first[1:]
    at = np.flatnonzero(keep)
    own = letters[at].astype(np.uint64)
    doc = np.repeat(np.arange(batch.n_docs), np.diff(firsts))[at]
    starts = np.searchsorted(at, firsts[:-1])
    place = np.arange(len(at)) - starts[doc]
    key = own.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(own)
        earlier[back:] = own[:-back] if back < len(own) else own[:0]
        earlier[place < back] = 0
        key |= earlier << np.uint64(_BITS * back)
    return key, doc, np.bincount(doc, minlength=batch.n_docs) > 0


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of the texts of each language and fold."""
    held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, judged), parts in held.items():
            keys, counts = _merged(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(keys), lang), pa.int32()), "judged": pa.array(np.full(len(keys), judged)), "key": keys.view(np.int64), "n": counts})
        held.clear()

    for batch in batches:
        langs, judged = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for lang, fold in sorted(set(zip(langs.tolist(), judged.tolist()))):
            own = pa.array(np.flatnonzero((langs == lang) & (judged == fold)))
            for _, _, piece in TextBatch.pieces(batch.column(2).take(own)):
                parts = held.setdefault((lang, fold), [])
                parts.append(np.unique(keys_of(piece)[0], return_counts=True))
                if sum(len(k) for k, _ in parts) > HELD:
                    parts[:] = [_merged(parts)]
                if sum(len(k) for p in held.values() for k, _ in p) > HELD:
                    yield from rows()
    yield from rows()


def hashes(keys: np.ndarray) -> np.ndarray:
    # every step of ``mix`` can be undone
    return mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Sorted:
    """Rows of numbers by key: sorted hashes and an index of their leading bits."""

    hashes: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        bits = max(4, int(len(self.hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        size = np.diff(np.append(self.index, len(self.hashes)))
        self.steps = int(size.max(initial=0))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> "Sorted":
        h = hashes(keys)
        order = np.argsort(h)
        return cls(h[order], values[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        h = hashes(keys)
        at = self.index[(h >> self.shift).astype(np.int64)]
        left, last = np.arange(len(keys)), len(self.hashes) - 1
        for step in range(self.steps):
            here = at[left] + step
            found = self.hashes[np.minimum(here, last)]
            wanted = h[left]
            hit = (found == wanted) & (here <= last)
            out[left[hit]] = here[hit]
            left = left[(found < wanted) & (here < last)]
            if not len(left):
                break
        return out


def suffix(keys: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` characters of each key."""
    return keys & np.uint64((1 << _BITS * size) - 1)


@dataclass
class Model:
    """Joint models: log probabilities of keys of 1 to ``ORDER`` characters and log back-off weights of contexts, a column a language."""

    langs: list[str]
    keys: list[Sorted]
    contexts: list[Sorted]
    unseen: np.ndarray

    def logs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probability of each key's last character after those before it, in every language."""
        out = np.zeros((len(keys), len(self.langs)))
        left = np.arange(len(keys))
        for k in range(order, 0, -1):
            own = suffix(keys[left], k)
            row = self.keys[k - 1].find(own)
            known = row >= 0
            out[left[known]] += self.keys[k - 1].values[row[known]]
            left, own = left[~known], own[~known]
            if k == 1:
                out[left] += self.unseen
                break
            if not len(left):
                break
            row = self.contexts[k - 1].find(own >> np.uint64(_BITS))
            known = row >= 0
            out[left[known]] += self.contexts[k - 1].values[row[known]]
        return out

    def entropies(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (bits a character) of each text in every language, and its characters."""
        keys, doc, _ = keys_of(batch)
        total = np.zeros((batch.n_docs, len(self.langs)))
        for lo in range(0, len(keys), 1 << 18):
            own = doc[lo : lo + (1 << 18)]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(self.logs(keys[lo : lo + (1 << 18)]), first, axis=0)
        n = np.bincount(doc, minlength=batch.n_docs)
        return -total / math.log(2) / np.maximum(n, 1)[:, None], n


def joint(langs: list[str], kept: list[list[tuple[np.ndarray, np.ndarray]]], weights: list[list[tuple[np.ndarray, np.ndarray]]], spare: np.ndarray) -> Model:
    """``kept[order - 1][lang]``: keys and discounted shares; ``weights`` likewise: contexts and back-off weights; ``spare``: weight of the even spread."""
    model = Model(langs, [], [], np.log(spare / ALPHABET))
    for order in range(1, ORDER + 1):
        contexts = np.unique(np.concatenate([c for c, _ in weights[order - 1]]))
        logs = np.zeros((len(contexts), len(langs)))
        for lang, (own, weight) in enumerate(weights[order - 1]):
            logs[np.searchsorted(contexts, own), lang] = np.log(np.maximum(weight, 1e-12))
        model.contexts.append(Sorted.of(contexts, logs.astype(np.float32)))
        keys = np.unique(np.concatenate([k for k, _ in kept[order - 1]]))
        if order == 1:
            lower = np.repeat(spare[None, :] / ALPHABET, len(keys), axis=0)
        else:
            row = model.contexts[-1].find(keys >> np.uint64(_BITS))
            back = np.where((row >= 0)[:, None], model.contexts[-1].values[row] if len(contexts) else 0.0, 0.0)
            lower = np.exp(back + model.logs(keys, order - 1))
        for lang, (own, share) in enumerate(kept[order - 1]):
            lower[np.searchsorted(keys, own), lang] += share
        model.keys.append(Sorted.of(keys, np.log(lower).astype(np.float32)))
    return model


def _levels(counts: DataFrame) -> DataFrame:
    """``model, ord, lang, key, n`` of keys of all orders."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << _BITS * order) - 1).cast("long")
        levels.append(levels[-1].groupBy("model", "lang", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    every = None
    for order, level in zip(range(ORDER, 0, -1), levels):
        told = level.select("model", F.lit(order).alias("ord"), "lang", "key", "n")
        every = told if every is None else every.unionByName(told)
    return written(every)


def _fits(every: DataFrame, langs: int) -> bool:
    """Whether the whole joint model, no key left out, has at most ``CELLS`` cells."""
    return every.where("model = 1").select("ord", "key").distinct().count() * langs <= CELLS


def _tables(every: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Discounted shares of the keys that make up a share of ``least`` of their language's order, and back-off weights of their contexts."""
    # one row for each model, order and language
    stats = every.groupBy("model", "ord", "lang").agg(
        F.sum("n").alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2")
    )
    discount = F.when(F.col("n1") > 0, F.least(F.lit(0.95), F.col("n1") / (F.col("n1") + 2 * F.col("n2")))).otherwise(0.5)
    stats = stats.select("model", "ord", "lang", F.greatest(F.lit(1.0), F.col("total") * least).alias("least"), discount.alias("d"))
    parts = every.join(F.broadcast(stats), ["model", "ord", "lang"]).withColumn("context", F.shiftrightunsigned("key", _BITS)).withColumn("is_kept", F.col("n") >= F.col("least"))
    by = ["model", "ord", "lang", "context"]
    contexts = parts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("is_kept"), F.col("n") - F.col("d")).otherwise(0.0)).alias("mass"), F.max("is_kept").alias("any_kept")).where("any_kept")
    contexts = written(contexts.select(*by, "total", (1 - F.col("mass") / F.col("total")).alias("weight")))
    shares = parts.where("is_kept").join(contexts, by).select("model", "ord", "lang", "key", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
    return shares, contexts


def build(counts: DataFrame, langs: list[str]) -> list[Model]:
    """Models of ``counts`` (model, lang, key, n); at most ``CELLS`` cells a model come to the driver.

    Whole if they fit. If not, these are without their rarest keys; ``train`` then takes ``tabled``, which has all.
    """
    every = _levels(counts)
    return _built(every, langs, 0.0 if _fits(every, len(langs)) else len(langs) ** 2 * ORDER / CELLS)


def _built(every: DataFrame, langs: list[str], least: float) -> list[Model]:
    shares, contexts = _tables(every, least)
    by = ["model", "ord", "lang", "context"]
    found = shares.toArrow()
    backs = contexts.select("model", "ord", "lang", F.col("context").alias("key"), F.col("weight").alias("share")).toArrow()
    models = []
    for number in range(2):
        split = []
        for table in (found, backs):
            model, order, lang, key, share = (table.column(c).to_numpy() for c in ("model", "ord", "lang", "key", "share"))
            own = [[(model == number) & (order == k) & (lang == i) for i in range(len(langs))] for k in range(1, ORDER + 1)]
            split.append([[(key[at].view(np.uint64), share[at]) for at in row] for row in own])
        kept, weights = split
        # the empty context: what letters leave to the even spread
        spare = np.array([w[0] if len(w) else 1.0 for _, w in weights[0]])
        models.append(joint(langs, kept, weights, np.maximum(spare, 1e-9)))
    return models


@dataclass
class Tabled:
    """A whole model that is too large to be sent to tasks: shares and back-off weights as tables."""

    langs: list[str]
    shares: DataFrame
    contexts: DataFrame

    def logs(self, keys: DataFrame) -> DataFrame:
        """``(key, logs)``: natural log probability of each key's last character in every language, as ``Model.logs``."""
        spark = keys.sparkSession
        spare = self.contexts.where("ord = 1").select("lang", F.greatest(F.lit(1e-9), "weight").alias("spare"))
        langs = spark.createDataFrame([(i,) for i in range(len(self.langs))], "lang int").join(spare, "lang", "left")
        rows = keys.crossJoin(F.broadcast(langs)).select("key", "lang", (F.coalesce("spare", F.lit(1.0)) / ALPHABET).alias("p"))
        for order in range(1, ORDER + 1):
            end = F.col("key") if order == ORDER else F.col("key").bitwiseAND(F.lit((1 << _BITS * order) - 1).cast("long"))
            share = self.shares.where(F.col("ord") == order).select("lang", F.col("key").alias("end"), "share")
            rows = rows.withColumn("end", end).join(share, ["lang", "end"], "left")
            weight = F.lit(1.0)
            if order > 1:
                context = self.contexts.where(F.col("ord") == order).select("lang", "context", "weight")
                rows = rows.withColumn("context", F.shiftrightunsigned("end", _BITS)).join(context, ["lang", "context"], "left")
                # a context that a language does not have leaves all to the shorter key
                weight = F.greatest(F.lit(1e-12), F.coalesce("weight", F.lit(1.0)))
            rows = rows.select("key", "lang", (F.coalesce("share", F.lit(0.0)) + weight * F.col("p")).alias("p"))
        ordered = F.sort_array(F.collect_list(F.struct("lang", F.log("p").alias("log"))))
        return rows.groupBy("key").agg(F.transform(ordered, lambda x: x["log"]).alias("logs"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """``(row, entropies, n)`` of the texts with a letter of ``(row, text)``; each distinct key of the texts is looked up once, by joins."""
        told = written(texts.select("row", "text").mapInArrow(_text_keys, "row long, key long, n long"))
        met = told.join(written(self.logs(told.select("key").distinct())), "key")
        sums = [F.sum(F.col("n") * F.col("logs")[i]) for i in range(len(self.langs))]
        found = met.groupBy("row").agg(F.array(*sums).alias("total"), F.sum("n").alias("n"))
        return found.select("row", F.transform("total", lambda t: -t / math.log(2) / F.col("n")).alias("entropies"), "n")


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each key is in each text."""
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            keys, doc, _ = keys_of(batch)
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.empty(0, np.int64)
            row = rows.column(0).slice(lo, hi - lo).take(pa.array(doc[first]))
            yield pa.RecordBatch.from_arrays([row, pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], names=["row", "key", "n"])


def tabled(every: DataFrame, langs: list[str]) -> list[Tabled]:
    """The models of all keys, as tables."""
    shares, contexts = _tables(every, 0.0)
    shares = written(shares)
    return [Tabled(langs, *[t.where(F.col("model") == number).drop("model") for t in (shares, contexts)]) for number in range(2)]


@dataclass
class Calibration:
    """What turns entropies into a chance and a verdict."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    limit: float

    @staticmethod
    def facts(entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Lead over the second best, the lead times the root of the length, and the length's log."""
        best = np.partition(entropies, 1, axis=1)[:, :2] if entropies.shape[1] > 1 else np.column_stack([entropies[:, 0], entropies[:, 0] + 1])
        lead = best[:, 1] - best[:, 0]
        return np.column_stack([lead, np.sqrt(n) * lead, np.log1p(n)])

    @classmethod
    def of(cls, entropies: np.ndarray, n: np.ndarray, truth: np.ndarray) -> "Calibration":
        langs = entropies.shape[1]
        mean, spread = np.full(langs, np.inf), np.ones(langs)
        if not len(n):
            return cls(np.array([0.0, 0.0, 1.0, 0.0]), np.zeros(3), np.ones(3), mean, spread, np.inf)
        facts = cls.facts(entropies, n)
        centre, scale = facts.mean(axis=0), np.maximum(facts.std(axis=0), 1e-9)
        rows = np.column_stack([np.ones(len(n)), (facts - centre) / scale])
        right = (entropies.argmin(axis=1) == truth).astype(float)
        weights = np.zeros(rows.shape[1])
        # ridge-penalised Newton steps; two made-up rows keep the chance inside (0, 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.eye(len(weights)), rows.T @ (right - p) - weights)
            weights += step
            if np.abs(step).max() < 1e-9:
                break
        off = np.zeros(len(n))
        for lang in range(langs):
            own = (truth == lang) & (right > 0)
            if own.any():
                value = entropies[own, lang]
                mean[lang] = np.average(value, weights=n[own])
                spread[lang] = max(float(np.sqrt(np.average(n[own] * (value - mean[lang]) ** 2))), 1e-6)
                off[own] = (value - mean[lang]) * np.sqrt(n[own]) / spread[lang]
        limit = float(np.quantile(off[right > 0], 1 - REJECTED)) if right.any() else np.inf
        return cls(weights, centre, scale, mean, spread, max(limit, 1.0))

    def judge(self, entropies: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, chance and verdict of each text."""
        lang = entropies.argmin(axis=1)
        rows = np.column_stack([np.ones(len(n)), (self.facts(entropies, n) - self.centre) / self.scale])
        score = 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))
        value = entropies[np.arange(len(n)), lang]
        above = np.where(np.isfinite(self.mean[lang]), (value - np.where(np.isfinite(self.mean), self.mean, 0)[lang]) * np.sqrt(n) / self.spread[lang], 0.0)
        return lang, score, (score >= ACCEPT) & (above <= self.limit)


def _judged(model: Model, calibration: Calibration, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(2)):
            yield _verdicts(model.langs, calibration, rows.slice(lo, hi - lo), *model.entropies(batch))


def _judged_sums(langs: list[str], calibration: Calibration, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        n = rows.column(3).fill_null(0).to_numpy(zero_copy_only=False)
        entropies = np.zeros((rows.num_rows, len(langs)))
        entropies[n > 0] = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
        yield _verdicts(langs, calibration, rows, entropies, n)


def _verdicts(known: list[str], calibration: Calibration, rows: pa.RecordBatch, entropies: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    langs = np.array([*known, "und"], dtype=object)
    lang, score, accepted = calibration.judge(entropies, n)
    none = n == 0
    lang = np.where(none, len(known), lang)
    value = np.where(none, np.nan, entropies.min(axis=1))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0), rows.column(1), pa.array(langs[lang].tolist(), pa.string()), pa.array(np.where(none, 0.0, score)),
            pa.array(accepted & ~none), pa.array(value, mask=none), pa.array(n.astype(np.int64)),
        ],
        names=["doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy", "n_characters"],
    )


def fold(key: str):
    """Fold of a document, 0 to 3; fold 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Model | Tabled, Calibration] | None:
    """Model of the training folds, with all their keys, and its calibration; None if there is nothing to learn from."""
    taught = docs.where((fold(key) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # a row for each language
    langs = sorted(r[0] for r in taught.select(F.col(lang).cast("string").alias("lang")).distinct().collect())
    if not langs:
        return None
    number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
    rows = taught.select(number[F.col(lang).cast("string")].alias("lang"), (fold(key) == 3).alias("judged"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "lang int, judged boolean, key long, n long")
    # model 0 is counted without the fold that calibrates, model 1 on all
    sums = written(counted.groupBy("lang", "key").agg(F.sum("n").alias("all"), F.sum(F.when(~F.col("judged"), F.col("n"))).alias("part")))
    if sums.isEmpty():
        return None
    both = F.array(F.struct(F.lit(0).alias("model"), F.col("part").alias("n")), F.struct(F.lit(1).alias("model"), F.col("all").alias("n")))
    counts = sums.select("lang", "key", F.explode(F.filter(both, lambda x: x["n"].isNotNull())).alias("c")).select("c.model", "lang", "key", "c.n")
    every = _levels(counts)
    smaller, model = _built(every, langs, 0.0) if _fits(every, len(langs)) else tabled(every, langs)
    n_judged = rows.where("judged").count()
    sample = rows.where("judged").sample(min(1.0, SAMPLE_DOCS / max(n_judged, 1)), seed=5).select("lang", "text")
    if isinstance(smaller, Tabled):
        sample = written(sample.withColumn("row", F.monotonically_increasing_id()))
        found = smaller.entropies(sample).join(sample, "row").select("lang", "n", "entropies").toArrow()
    else:
        found = sample.mapInArrow(partial(_sampled, smaller), "lang int, n long, entropies array<double>").toArrow()
    entropies = np.array(found.column("entropies").to_pylist(), dtype=float).reshape(-1, len(langs))
    return model, Calibration.of(entropies, found.column("n").to_numpy().astype(float), found.column("lang").to_numpy())


def _sampled(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entropies of texts with a letter."""
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            entropies, n = model.entropies(batch)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array(list(entropies[some]), pa.list_(pa.float64()))], names=["lang", "n", "entropies"]
            )


COLUMNS = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double, n_characters long"


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for every row of ``docs``, in the columns of ``COLUMNS``."""
    trained = train(docs, key, text, lang)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(key) == 2).alias("held_out"), F.col(text).cast("string").alias("text"))
    if trained is None:
        und = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(0).cast("long").alias("n_characters")]
        return rows.select("doc_id", "held_out", *und)
    model, calibration = trained
    if isinstance(model, Model):
        return rows.mapInArrow(partial(_judged, model, calibration), COLUMNS)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    summed = rows.drop("text").join(model.entropies(rows), "row", "left").select("doc_id", "held_out", "entropies", "n")
    return summed.mapInArrow(partial(_judged_sums, model.langs, calibration), COLUMNS)
