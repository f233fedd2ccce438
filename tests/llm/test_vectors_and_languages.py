"""Clustering, whitening and language identification against plain versions, on edge cases and on held-out rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import languages, lloyd, whiten
from marginalia.llm.queries import QUERIES
from marginalia.llm.shipping import ship
from marginalia.llm.textbatch import TextBatch

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
#: columns beside the vectors have names that the operators use inside
VECTORS = "vec_id long, embedding array<double>, index int, x string, chunk int, row string, task int, cluster int"


@pytest.fixture(scope="module")
def llm(spark):
    ship(spark)
    return spark


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "r", 3, 4) for i, v in rows], VECTORS)


def some_vectors(seed: int, n: int, width: int):
    """Repeated ids, equal vectors that make up a third, ties between centroids, null ids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=width).round(2).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * width) for i in range(n // 2)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [1.0] * width)]
    return rows


def bad_vectors(width: int):
    return [(2000, None), (2001, []), (2002, [1.0] * (width + 1)), (2003, [None] + [1.0] * (width - 1)), (2004, [NAN] * width), (2005, [INF] + [0.0] * (width - 1)), (2006, [1.0])]


# 11 centroid clustering


def plain_lloyd(rows, width, centroids, rounds):
    ids = [i for i, _ in rows]
    x = np.clip(np.floor(64 * np.array([v for _, v in rows])), -lloyd.LIMIT, lloyd.LIMIT).astype(np.int64)
    hashed = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, "" if ids[i] is None else hashed(ids[i]), x[i].tolist()))
    c = x[order[:centroids]].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if turn < rounds:
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = [int(s) // int((near == k).sum()) for s in x[near == k].sum(axis=0)]
    dist = d.min(axis=1)
    told = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((i, int(k), int(e), int(dist[near == k].sum()), int(dist.sum()), told[k]) for i, k, e in zip(ids, near, dist)), key=str)


@pytest.mark.parametrize(("width", "centroids", "n"), [(64, 16, 150), (80, 5, 60), (3, 16, 8), (64, 16, 5)])
def test_clusters_equal_plain_rounds(llm, width, centroids, n):
    good = some_vectors(width + n, n, width)
    df = frame(llm, good + bad_vectors(width)).repartition(5)
    got = lloyd.clusters(df, width=width, centroids=centroids)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(good, width, centroids, 3)


def test_clusters_of_large_values_and_of_nothing(llm):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=64) * 10 ** rng.integers(0, 6)).tolist()) for i in range(40)]
    assert sorted((tuple(r) for r in lloyd.clusters(frame(llm, good)).collect()), key=str) == plain_lloyd(good, 64, 16, 3)
    far = lloyd.clusters(frame(llm, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64), (4, [1e300] * 64)]), centroids=1).collect()
    assert len(far) == 4 and {r["inertia"] for r in far} <= {None, sum(r["distance"] for r in far)}
    for rows in ([], bad_vectors(64)):
        empty = lloyd.clusters(frame(llm, rows))
        assert empty.count() == 0 and empty.columns[-1] == "centroid_sha256"


def test_partial_distances_are_exact_on_both_sides_of_the_double_limit():
    rng = np.random.default_rng(8)
    for most in (5, 30_000, lloyd.DOUBLE_LIMIT, lloyd.LIMIT):
        x, c = rng.integers(-most, most + 1, (50, 32)), rng.integers(-most, most + 1, (7, 32))
        expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
        assert lloyd.squared(lloyd.narrow(x), c).tolist() == expected


def test_chunks_of_many_rows_and_a_label_for_each(llm, monkeypatch):
    monkeypatch.setattr(lloyd, "CHUNK", 7)
    good = some_vectors(9, 90, 64)
    assert sorted((tuple(r) for r in lloyd.clusters(frame(llm, good)).collect()), key=str) == plain_lloyd(good, 64, 16, 3)


# 12 embedding whitening


def plain_whitening(rows):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(values)[::-1][:16] if values[i] > 1e-12 * values.max()]
    return n, [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))) for v in x], ((n * x - s) / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize(("width", "n"), [(64, 200), (5, 40), (64, 9), (20, 3000)])
def test_whitening_equals_plain_version(llm, width, n):
    rng = np.random.default_rng(width)
    good = [(i, (v * np.linspace(1, 3, width)).tolist()) for i, (_, v) in enumerate((k, np.array(v)) for k, v in some_vectors(n, n, width))]
    got = sorted(whiten.whitened(frame(llm, good + [b for b in bad_vectors(width) if b[0] not in (2000 + len(bad_vectors(width)),)]).repartition(3)).collect(), key=lambda r: (r["vec_id"], r["component"]))
    count, deviations, z, explained = plain_whitening(good)
    k = z.shape[1]
    assert len(got) == len(good) * k and {r["n"] for r in got} == {count} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    assert [r["deviation"] for r in got[::k]] == deviations
    mine = np.array([r["whitened"] for r in got]).reshape(-1, k)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-6
    assert np.allclose([r["explained"] for r in got[:k]], explained, rtol=1e-6) and rng is not None


def test_whitening_without_directions(llm):
    one = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]
    for rows in ([], one, bad_vectors(2)[:2], [(1, []), (2, [])]):
        got = whiten.whitened(frame(llm, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # one direction only; a repeated and a null id are rows like others; a far value
    got = whiten.whitened(frame(llm, [(1, [0.0, 1.0]), (1, [0.0, 3.0]), (None, [0.0, 1.0]), (5, [0.0, 2.0])])).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and got[0]["n"] == 3 and got[0]["explained"] == pytest.approx(1)
    far = whiten.whitened(frame(llm, [(1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [5.0, 1.0])])).collect()
    assert {r["component"] for r in far} == {1} and {r["deviation"] for r in far} == {None} | {r["deviation"] for r in far}


def test_whitening_of_the_most_common_width(llm):
    got = whiten.whitened(frame(llm, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [2.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3}


# 13 language identification


def line_of(text):
    """Classes of a text's characters as the models see them."""
    out = []
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out.append(ord(low) if len(low) == 1 else ord(c))
        elif out and out[-1]:
            out.append(0)
    return out


def tuples_of(text):
    line = line_of(text)
    if line and line[-1]:
        line.append(0)
    padded = [0] * (languages.ORDER - 1) + line
    return [tuple(padded[i : i + languages.ORDER]) for i in range(len(line))]


class PlainKneserNey:
    """The same model in dictionaries, nothing dropped."""

    def __init__(self, texts):
        self.counts = {languages.ORDER: Counter(g for t in texts for g in tuples_of(t))}
        for k in range(languages.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.total, self.types, self.d = defaultdict(float), defaultdict(int), {}
        for k, counts in self.counts.items():
            n1, n2 = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
            self.d[k] = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
            for g, v in counts.items():
                self.total[g[:-1], k] += v
                self.types[g[:-1], k] += 1

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / languages.ALPHABET
        lower = self.p(gram[1:])
        total = self.total.get((gram[:-1], k))
        if not total:
            return lower
        c = self.counts[k].get(gram, 0)
        return max(c - self.d[k], 0) / total * (c > 0) + self.d[k] * self.types[gram[:-1], k] / total * lower

    def entropy(self, text):
        grams = tuples_of(text)
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


TEXTS = {
    "aa": ["The river runs; the rivers ran. Ölü 12 über!", "a rivet in the rim, the rim in a river", "then there"],
    "bb": ["el río corre y los ríos corren", "la rima de la rivera ñandú", "日本語 el río"],
}


def models(llm):
    rows = [(lang, languages.keys_of(TextBatch.of([t]))[0]) for i, lang in enumerate(sorted(TEXTS)) for t in TEXTS[lang]]
    counts = Counter((m, sorted(TEXTS).index(lang), int(k)) for lang, keys in rows for k in keys.view(np.int64) for m in (0, 1))
    df = llm.createDataFrame([(*k, n) for k, n in counts.items()], "model int, lang int, key long, n long")
    return languages.build(df, sorted(TEXTS))


def test_keys_are_those_of_the_line():
    texts = ["Ab, c!", "", "12", None, " Straße\nİ x", "\U00020000 𐐀 y", "z"]
    keys, doc, some = languages.keys_of(TextBatch.of(texts))
    for i, text in enumerate(texts):
        # letters beyond the first plane are folded
        folded = [tuple(c if c < 1 << 16 else 1 + c % 65535 for c in g) for g in tuples_of(text)]
        assert [tuple(int(k) >> 16 * b & 0xFFFF for b in range(3, -1, -1)) for k in keys[doc == i]] == folded
        assert some[i] == any(c.isalpha() for c in text or "")


def test_models_equal_plain_kneser_ney(llm):
    judged = ["the river", "los ríos", "日本 xyz the", "q", "Ölü then ñ", "the rivers ran in the rim of a rivet"]
    for model in models(llm):
        entropies, n = model.entropies(TextBatch.of(judged))
        for lang, name in enumerate(model.langs):
            plain = PlainKneserNey(TEXTS[name])
            for i, text in enumerate(judged):
                assert n[i] == len(tuples_of(text)) and entropies[i, lang] == pytest.approx(plain.entropy(text), rel=1e-5)


def test_probabilities_sum_to_one_also_where_keys_are_dropped(llm, monkeypatch):
    every = np.arange(languages.ALPHABET, dtype=np.uint64)
    for cells in (languages.CELLS, 600):
        monkeypatch.setattr(languages, "CELLS", cells)
        model = models(llm)[1]
        assert all(len(s.hashes) * len(model.langs) <= max(cells, 600) for s in model.keys)
        for context in ("the", "\0ri", "xxx", "\0\0\0"):
            key = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
            total = np.exp(model.logs(every | np.uint64(key))).sum(axis=0)
            assert np.abs(total - 1).max() < 1e-3


def test_no_key_is_dropped_however_few_cells_are_sent(llm, monkeypatch):
    rows = [(i, text, lang) for i in range(40) for lang in TEXTS for text in [" ".join(TEXTS[lang])]]
    rows += [(500, None, "aa"), (501, "12 !?", "bb"), (502, "los ríos", None), (503, "日本 xyz the", None), (503, "the rivers ran in the rim", None)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = [sorted(map(tuple, languages.languages(df).select("doc_id", "lang_pred", "accepted", "n_characters", "cross_entropy", "score").fillna(-1).collect()))]
    monkeypatch.setattr(languages, "CELLS", 100)
    judged.append(sorted(map(tuple, languages.languages(df).select("doc_id", "lang_pred", "accepted", "n_characters", "cross_entropy", "score").fillna(-1).collect())))
    assert len(judged[0]) == len(judged[1]) == len(rows)
    for one, other in zip(*judged):
        assert one[:4] == other[:4] and one[4:] == pytest.approx(other[4:], rel=1e-4, abs=1e-4)


def test_sorted_hashes_find_all_and_nothing_else():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        table = languages.Sorted.of(keys, np.arange(len(keys)))
        found = table.find(keys)
        assert table.values[found].tolist() == list(range(len(keys)))
        assert (table.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 1


DOCS = "doc_id long, text string, lang string, source string, key long, n long, model int, judged boolean"


def test_languages_of_edge_cases(llm):
    def fold(i):
        return zlib.crc32(str(i if i is not None else "").encode()) % 4

    rows = [(i, t, lang) for i in range(80) for lang in TEXTS for t in [" ".join(TEXTS[lang])]]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 !?", "bb"), (503, "the river", None), (504, "los ríos corren", None), (None, "the river runs", "aa"), (505, "the river " * 50_000, None), (505, "the river " * 50_000, None), (506, "x", "aa")]
    df = llm.createDataFrame([(*r, "s", 1, 2, 3, True) for r in rows], DOCS).repartition(3)
    got = languages.languages(df)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r["doc_id"]].append(r)
        assert r["held_out"] == (fold(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und")
    assert all(by_id[i][0]["lang_pred"] == "und" and by_id[i][0]["score"] == 0 and not by_id[i][0]["accepted"] for i in (500, 501, 502))
    assert [by_id[i][0]["lang_pred"] for i in (503, 504, None)] == ["aa", "bb", "aa"] and [r["lang_pred"] for r in by_id[505]] == ["aa"] * 2
    assert sorted(r["lang_pred"] for r in by_id[7]) == ["aa", "bb"]
    assert languages.languages(df.where("false")).count() == 0
    untaught = languages.languages(df.withColumn("lang", df["source"].substr(9, 1)).where("doc_id > 502").replace({"": None}, subset=["lang"])).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}
    single = languages.languages(df.where("lang = 'bb'")).where("lang_pred <> 'bb'").collect()
    assert [r["doc_id"] for r in single] == [502]


def test_held_out_documents_and_what_is_learned(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in languages.languages(docs).collect()}
    told = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    right = [got[i]["lang_pred"] == told[i] for i in held]
    assert np.mean(right) > 0.98 and np.mean([got[i]["accepted"] for i in held]) > 0.97
    # chances are calibrated: about as many errors as they say
    assert abs(np.mean([1 - got[i]["score"] for i in held]) - (1 - np.mean(right))) < 0.03
    # what lies in the held-out fold is not learned, and neither language nor source of a judged text counts
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(languages.fold("doc_id") == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    again = {r["doc_id"]: r for r in languages.languages(other).collect()}
    assert all(again[i]["lang_pred"] == r["lang_pred"] and abs(again[i]["score"] - r["score"]) < 0.02 for i, r in got.items())
    # letters of no language are rejected
    model, calibration = languages.train(docs)
    entropies, n = model.entropies(TextBatch.of(["это совсем другой язык и другие буквы " * 5, "the and of"]))
    assert calibration.judge(entropies, n)[2].tolist()[0] is False


@pytest.mark.parametrize("name", ["op11_clusters", "op12_whitening", "op13_languages"])
def test_queries_cover_their_tables(llm, name):
    table, times = {"op11_clusters": ("embeddings", 1), "op12_whitening": ("embeddings", 16), "op13_languages": ("documents", 1)}[name]
    assert QUERIES[name](llm, SF).count() == times * llm.read.parquet(f"{SF}/{table}.parquet").count()
