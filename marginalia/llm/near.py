"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Words are runs without blanks, A-Z lower-cased; a shingle is five words in a row (all words of a
shorter text). A shingle's weight is its count times ``(1 + i) / 2``, where ``i`` is the inverse
document frequency ``ln(n / df) / ln(1 / FREQUENT)``, at most 1. It is counted exactly, over
all documents, for every shingle in at least ``FREQUENT`` of them; rarer ones have ``i = 1`` whatever their
count. So the table that tasks need holds at most (mean shingles a document) / FREQUENT rows at any size.

1. ``frequent``: occurrences fall into a fixed number of slots; a shingle of a slot with too few is
   not frequent. The others are counted by value. Counts are summed in tasks before they move.
2. ``signatures``: sample ``k`` of a text is the shingle with the smallest
   ``ln c - r (floor(ln w / r + b) - b) - r`` and its floor. The gamma variates ``r, c`` and the uniform ``b``
   belong to (slot of the shingle, k). For weight 1, nearly all shingles, the value is read from a table.
3. Texts of equal shingle counts are one node: copies never meet each other.
4. Bands of samples make buckets. In each bucket a few nodes are centres (the smallest under some orders) and
   every node is compared with them: the work is linear in the bucket.
5. Pairs are verified on the whole texts: sum of smaller weights over sum of larger ones is at least
   ``SIMILARITY``. Verified links make components.
6. Buckets that still hold two components or more are searched for links across them: blocks of bounded size
   meet in pairs of blocks, where all similarities are computed exactly as a matrix product. One link for each two
   components comes out, no pairs. Then the components are made again, so no link within a bucket is lost.

Cases: null, empty and blank texts have no shingles; each is a class of its own. Repeated rows
share a class. An empty table gives no rows. Equal ids with different texts are different rows, and null ids are
like other ids; ``deduplicated`` keeps the rows that lead, so of two texts under one id only those that lead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.textbatch import BLANKS, TextBatch, mix
from marginalia.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
#: share of the documents from which a shingle's document frequency is told apart
FREQUENT = 0.01
#: samples of a text, and samples of a band
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: slots of counts in the search for frequent shingles
COUNT_SLOTS = 1 << 18
#: slots of random variates
DRAW_SLOTS = 1 << 15
#: orders in which a bucket names a centre
CENTRES = (0, 0x5DEECE66D1CE4E5B)
#: nodes and shingles of a block (about)
BLOCK, BLOCK_ELEMENTS = 512, 400_000


def shingles(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle, repeats included."""
    words = batch.lowered().spans(BLANKS)
    hashes, docs = words.windows(WORDS)
    short = (words.counts > 0) & (words.counts < WORDS)
    if short.any():
        parts = [(hashes, docs)]
        for size in range(1, WORDS):
            h, d = words.windows(size)
            mine = words.counts[d] == size
            parts.append((h[mine], d[mine]))
        hashes, docs = (np.concatenate(x) for x in zip(*parts))
    return hashes, docs


def counted(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) in that order, with counts."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(docs[order], kind="stable")]
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


class Weights:
    """Weights of shingles, from the frequent ones (sorted hashes) and their document frequencies."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_docs: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        span = math.log(1 / FREQUENT)
        idf = np.clip(np.log(np.maximum(n_docs, 1) / np.maximum(counts[order], 1)) / span, 0.0, 1.0)
        self.factors = (1 + idf) / 2

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            out[found] *= self.factors[at[found]]
        return out


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNT_SLOTS, dtype=np.int64)
    for rows in batches:
        for _, _, batch in TextBatch.pieces(rows.column(0)):
            total += np.bincount((shingles(batch)[0] & np.uint64(COUNT_SLOTS - 1)).astype(np.int64), minlength=COUNT_SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def _exact_counts(open_slots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = []
        for _, _, batch in TextBatch.pieces(rows.column(0)):
            hashes, docs = shingles(batch)
            may = open_slots[(hashes & np.uint64(COUNT_SLOTS - 1)).astype(np.int64)]
            found.append(counted(hashes[may], docs[may])[0])
        if found:
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())})


def frequent(docs: DataFrame, n_docs: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``FREQUENT`` of the documents (two or more), with their document frequencies."""
    least = max(2, math.ceil(FREQUENT * n_docs))
    texts = docs.select(text)
    slots = texts.mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    open_slots = np.zeros(COUNT_SLOTS, dtype=bool)
    open_slots[[r["slot"] for r in slots.select("slot").toLocalIterator()]] = True
    if not open_slots.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    counts = texts.mapInArrow(partial(_exact_counts, open_slots), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.toArrow()
    return found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variates ``r, ln c, b`` by (sample, slot), and the sortable value for weight 1 in the upper half of 64 bits."""
    cell = np.arange(SAMPLES * DRAW_SLOTS, dtype=np.uint64).reshape(SAMPLES, DRAW_SLOTS)

    def uniform(i: int) -> np.ndarray:
        return ((mix(cell * np.uint64(5) + np.uint64(i + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    r = -np.log(uniform(0) * uniform(1))
    log_c = np.log(-np.log(uniform(2) * uniform(3)))
    b = uniform(4)
    value = sortable(log_c + r * b - r)
    return r.astype(np.float32), log_c.astype(np.float32), b.astype(np.float32), value


def sortable(x: np.ndarray) -> np.ndarray:
    """Numbers as 32 bits in the same order, moved to the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return bits.astype(np.uint64) << np.uint64(32)


def samples(hashes: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sample values (64 bits), a row for each document that has shingles; input sorted by document."""
    r, log_c, b, unit = _draws()
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    slots = (mix(hashes ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(DRAW_SLOTS - 1)).astype(np.int64)
    place = np.arange(len(hashes), dtype=np.uint64)
    other = np.flatnonzero(weights != 1)
    other_slots, log_w = slots[other], np.log(weights[other])
    out = np.empty((len(first), SAMPLES), dtype=np.uint64)
    level = np.zeros(len(hashes), dtype=np.int64)
    for k in range(SAMPLES):
        key = unit[k][slots]
        if len(other):
            rk, bk = r[k][other_slots].astype(np.float64), b[k][other_slots]
            t = np.floor(log_w / rk + bk)
            key[other] = sortable(log_c[k][other_slots] - rk * (t - bk) - rk)
            level[other] = t
        best = (np.minimum.reduceat(key | place, first) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = mix(hashes[best] + (level[best] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


SIGNATURE = "doc_id long, text_hash long, mark binary, size long, bands array<long>"


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, size = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def marks(hashes: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Sixteen bytes that equal shingle counts have in common, for each document."""
    out = np.zeros((n_docs, 2), dtype=np.uint64)
    for i, salt in enumerate((0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93)):
        np.add.at(out[:, i], docs, mix(hashes ^ np.uint64(salt)) * counts.astype(np.uint64))
    return out.view(np.uint8).reshape(n_docs, 16)


def _sign(weights: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            h, d, n = counted(*shingles(batch))
            if not len(h):
                continue
            w = weights.of(h, n)
            have = np.unique(d)
            drawn = samples(h, d, w)
            bands = np.zeros((len(have), BANDS), dtype=np.uint64)
            for i in range(BANDS):
                for j in range(ROWS):
                    bands[:, i] = mix(bands[:, i] + drawn[:, i * ROWS + j] + np.uint64(i))
            flat = pa.array(bands.view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(i).slice(lo, hi - lo).take(pa.array(have)) for i in (0, 2)], _fixed(marks(h, d, n, batch.n_docs)[have]),
                    pa.array(np.bincount(d, n, minlength=batch.n_docs)[have].astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * BANDS), flat),
                ],
                names=["doc_id", "text_hash", "mark", "size", "bands"],
            )


def _verify(weights: Weights, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, text of u, text of v) that are similar enough, with their similarity."""
    for rows in batches:
        n = len(rows)
        lo, step = 0, 256
        while lo < n:
            part = rows.slice(lo, step)
            lo += step
            sides = []
            for i in (2, 3):
                found = [(h, d + first, c) for first, _, batch in TextBatch.pieces(part.column(i)) for h, d, c in [counted(*shingles(batch))]]
                h, d, c = (np.concatenate(x) for x in zip(*found))
                sides.append((h, d, weights.of(h, c)))
            (ha, da, wa), (hb, db, wb) = sides
            total = np.bincount(da, wa, minlength=len(part)) + np.bincount(db, wb, minlength=len(part))
            h, d, w = np.concatenate([ha, hb]), np.concatenate([da, db]), np.concatenate([wa, wb])
            order = np.lexsort((h, d))
            h, d, w = h[order], d[order], w[order]
            both = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
            shared = np.bincount(d[both], np.minimum(w[both], w[both + 1]), minlength=len(part))
            similarity = shared / np.maximum(total - shared, 1e-300)
            good = np.flatnonzero(similarity >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good)), pa.array(similarity[good])], names=["u", "v", "similarity"])


def _vectors(weights: Weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of each text: a shingle and the number of its occurrence; their weights add up to the text's."""
    for rows in batches:
        for lo, hi, batch in TextBatch.pieces(rows.column(1)):
            h, d, n = counted(*shingles(batch))
            at = np.repeat(np.arange(len(h)), n)
            again = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            elements = mix(h[at] + again * np.uint64(0x9E3779B97F4A7C15))
            factors = weights.of(h, np.ones(len(h)))[at]
            ends = np.cumsum(np.bincount(d[at], minlength=batch.n_docs))[:-1]
            parts = [[x.tobytes() for x in np.split(v, ends)] for v in (elements, factors.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([rows.column(0).slice(lo, hi - lo), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["node", "elements", "factors"])


def similarities(left: list[dict], right: list[dict]) -> np.ndarray:
    """Weighted Jaccard similarity of every left and right node, exactly, from their elements."""
    sides = [[(np.frombuffer(m["elements"], dtype=np.uint64), np.frombuffer(m["factors"], dtype=np.float32)) for m in side] for side in (left, right)]
    elements = np.concatenate([e for side in sides for e, _ in side])
    factors = np.concatenate([f for side in sides for _, f in side]).astype(np.float64)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(e) for side in sides for e, _ in side])
    totals = np.bincount(owner, factors, minlength=len(left) + len(right))
    order = np.argsort(elements, kind="stable")
    new = np.concatenate([[True], np.diff(elements[order]) != 0])
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1
    number, at = number[often], order[often]
    number = np.cumsum(np.concatenate([[1], np.diff(number) != 0])) - 1 if len(number) else number
    shared = np.zeros((len(left), len(right)))
    width = 4096
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [first, first + width])
        dense = np.zeros((len(left) + len(right), width))
        dense[owner[at[lo:hi]], number[lo:hi] - first] = np.sqrt(factors[at[lo:hi]])
        shared += dense[: len(left)] @ dense[len(left) :].T
    return shared / np.maximum(totals[: len(left), None] + totals[None, len(left) :] - shared, 1e-300)


def _across(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components in a pair of blocks, one for each two components."""
    for rows in batches:
        us, vs = [], []
        for i in range(len(rows)):
            row = rows.slice(i, 1).to_pylist()[0]
            left, right = ([m for m in row["members"] if m["part"] == x] for x in (row["i"], row["j"]))
            if not left or not right:
                continue
            roots = [np.array([m["root"] for m in side]) for side in (left, right)]
            a, b = np.nonzero((similarities(left, right) >= least - 1e-9) & (roots[0][:, None] != roots[1][None, :]))
            two = np.sort(np.stack([roots[0][a], roots[1][b]], axis=1), axis=1)
            _, first = np.unique(two, axis=0, return_index=True)
            us += [left[x]["node"] for x in a[first]]
            vs += [right[x]["node"] for x in b[first]]
        yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _texts(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the asked nodes. An id may have several texts, and a null id is an id like others."""
    wanted = nodes.join(asked, "node").select("node", F.col("doc_id").alias("node_id"), F.col("text_hash").alias("node_hash"))
    both = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["node_id"]) & (docs["text_hash"] == wanted["node_hash"]))
    return both.groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links among ``pairs(u, v)``, with their similarity."""
    both = (
        pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
        .join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        .select("u", "v", "text_u", "text_v")
    )
    return both.mapInArrow(partial(_verify, weights, similarity), "u long, v long, similarity double")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row; class: smallest id among rows linked to each other, kept: one row of each class."""
    return classes(docs, key, text, similarity).drop("text_hash")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``near_duplicates`` with ``text_hash``, which tells the texts of one id apart."""
    whole = F.col(text).cast("string")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_hash"))
    n_docs = docs.count()
    weights = Weights(*frequent(docs, n_docs), n_docs)
    signed = docs.mapInArrow(partial(_sign, weights), SIGNATURE).withColumn("row", F.monotonically_increasing_id())
    signed = cut_lineage(signed)
    first = signed.groupBy("mark").agg(F.min("row").alias("node"))
    nodes = cut_lineage(signed.join(first, signed["row"] == first["node"], "left_semi").withColumn("node", F.col("row")).drop("row"))
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    centres = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.col("node").bitwiseXOR(F.lit(c))).alias(f"c{i}") for i, c in enumerate(CENTRES)]).where("n > 1")
    shared = cut_lineage(buckets.join(centres, ["band", "key"]))
    stars = shared.select("node", F.explode(F.array_distinct(F.array(*[F.col(f"c{i}").bitwiseXOR(F.lit(c)) for i, c in enumerate(CENTRES)]))).alias("centre")).where("node <> centre")
    pairs = cut_lineage(stars.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct())
    texts = cut_lineage(_texts(shared.select("node").distinct(), nodes, docs))
    links = cut_lineage(_verified(pairs, texts, weights, similarity))
    roots = components(links)
    # links across the components of one bucket
    known = shared.select("band", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "key")
    open_nodes = cut_lineage(known.join(mixed, ["band", "key"]).join(nodes.select("node", "size"), "node"))
    if not open_nodes.isEmpty():
        open_texts = texts.join(open_nodes.select("node").distinct(), "node", "left_semi").select("node", "text")
        vectors = open_texts.mapInArrow(partial(_vectors, weights), "node long, elements binary, factors binary")
        held = open_nodes.groupBy("band", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_ELEMENTS))).cast("int").alias("blocks"))
        placed = open_nodes.join(held, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        meeting = placed.join(vectors, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        grouped = meeting.groupBy("band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("part", "node", "root", "elements", "factors")).alias("members"))
        crossing = cut_lineage(grouped.select("i", "j", "members").mapInArrow(partial(_across, similarity), "u long, v long").distinct())
        roots = components(links.select("u", "v").union(crossing))
    members = signed.select("row", "doc_id", "text_hash", "mark").join(first, "mark").join(roots, "node", "left").select("row", "doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    lead = members.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("lead"))
    classed = members.join(lead, "root").select("doc_id", F.col("lead.doc_id").alias("class_id"), (F.col("row") == F.col("lead.row")).alias("kept"), "text_hash")
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "text_hash")
    return classed.unionByName(blank)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` that leads each class, with all its columns. Equal texts under one id are one row, blank ones if the whole rows are equal."""
    classed = classes(docs, key, text, similarity)
    kept = classed.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    kept = cut_lineage(kept.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"), (F.col("rows") > 1).alias("_again")))
    whole = F.col(text).cast("string")
    out = docs.join(kept, docs[key].cast("long").eqNullSafe(kept["_kept_id"]) & (F.xxhash64(whole) == kept["_kept_hash"]))
    once, again = out.where("not _again").select(*docs.columns), out.where("_again").select(*docs.columns)
    if kept.where("_again").isEmpty():
        return once
    worded = F.coalesce(whole.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return once.unionByName(again.where(worded).dropDuplicates([key, text])).unionByName(again.where(~worded).dropDuplicates())
