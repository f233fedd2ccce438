"""Training-data operators against plain versions, on edge cases and on held-out rows."""

from __future__ import annotations

import itertools
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, licenses, mixing, near, pii, quality, secrets, urls, warc
from marginalia.llm.components import components
from marginalia.llm.queries import QUERIES
from marginalia.llm.shipping import ship
from marginalia.llm.textbatch import BLANKS, TextBatch, hash_word
from tests.llm import plain_urls
from tests.llm.plain import secret_row

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, block string"
PROSE = "the quick brown fox jumps over a lazy dog while seven green birds sing near that old stone bridge by our river"


@pytest.fixture(scope="module")
def llm(spark):
    ship(spark)
    return spark


def prose(seed: int, n: int = 120) -> str:
    rng = np.random.default_rng(seed)
    words = PROSE.split() + [a + b for a in ("an", "re", "tion", "ou", "le") for b in ("ka", "mo", "ti", "su", "ve")]
    return " ".join(rng.choice(words, n))


#: null, empty, blank, very long, repeated and tied rows; a null id; columns whose names the operators use inside
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, prose(4)), (5, prose(4)), (5, prose(4)), (6, prose(6, 20_000)), (7, "x" * 100_000), (8, "one"), (9, "ß é\u00a0 日本語 " * 30),
    (None, prose(4)), (10, "password=hunter22 AKIA" + "B" * 20 + " a@b.co 10.0.0.1"), (10, "another text with this id"), (11, "Licensed under the Apache License, Version 2.0."),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", f"src{len(t or '') % 3}" if t else None, len(t or ""), True, 7, "b") for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# text batches


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té😀\x1f\x85", max_size=30)), max_size=8))
def test_words_of_batches(texts):
    batch = TextBatch.of(texts)
    spans = batch.spans(BLANKS)
    found = [[] for _ in texts]
    for a, b, d in zip(spans.starts, spans.ends, spans.docs):
        found[d].append(batch.data[a:b].tobytes().decode())
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found == expected
    assert [int(h) for h in spans.hashes] == [hash_word(w) for words in expected for w in words]


def test_pieces_and_take_agree_with_whole():
    import pyarrow as pa

    texts = [prose(i, 5 + i) for i in range(50)] + [None, "", "é" * 500]
    pieces = [x for _, _, b in TextBatch.pieces(pa.array(texts), 700) for x in b.spans(BLANKS).counts]
    whole = TextBatch.of(texts)
    assert pieces == whole.spans(BLANKS).counts.tolist()
    rows = np.array([2, 7, 52])
    assert whole.take(rows).spans(BLANKS).counts.tolist() == whole.spans(BLANKS).counts[rows].tolist()


# 1 quality


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + o for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_facts_and_order_free_verdict(llm):
    docs = frame(llm, TEXTS + [(20, "a b c\n" * 40), (21, "SHOUT LOUD NOW " * 3 + prose(3).upper()), (22, prose(5) + " ###|||$$$" * 40)])
    texts = docs.select("doc_id", "text").collect()
    expected = sorted(((r["doc_id"], *plain_quality(r["text"])) for r in texts), key=str)
    got = quality.quality(docs)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == expected
    forward, backward = (quality.quality(docs, rules) for rules in (quality.RULES, quality.RULES[::-1]))
    assert rows_of(forward.drop("rejected_by")) == rows_of(backward.drop("rejected_by"))
    verdict = {r["doc_id"]: r["kept"] for r in forward.collect()}
    assert verdict[4] and verdict[6] and not any(verdict[i] for i in (1, 2, 3, 7, 8, 20, 21, 22))
    assert rows_of(quality.kept(docs).select("doc_id", "block")) == rows_of(forward.where("kept").select("doc_id", F.lit("b").alias("block")))


def test_quality_cascade_short_circuits_by_gain(llm):
    seen = []

    def rule(name, fn):
        return quality.Rule(name, lambda f: seen.append((name, f.batch.n_docs)) or fn(f))

    rules = [rule("first", lambda f: f["n_words"] < 2), rule("second", lambda f: f["n_words"] > 3)]
    verdict, judged = quality.cascade(TextBatch.of(["a", "b", "c", "a b c d", "a b"]), rules)
    assert verdict.tolist() == [0, 0, 0, 1, -1] and judged.tolist() == [5, 2] and seen == [("first", 5), ("second", 2)]
    ranked = quality.ordered(frame(llm, [(i, "some words") for i in range(50)]))
    assert ranked[0].name == "few_words" and {r.name for r in ranked} == {r.name for r in quality.RULES}


# 2 personal data


def test_field_decodes_and_sums_like_enumeration():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    scores, move = rng.normal(size=(3, 4, k)), rng.normal(size=(k, k))
    length = np.array([4, 2, 1])
    best = pii.viterbi(scores, move, length)
    labels, moves, norm = pii.marginals(scores, move, length)
    total, expected_moves = 0.0, np.zeros((k, k))
    for n in range(3):
        paths = {p: sum(scores[n, i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=int(length[n]))}
        assert tuple(best[n, : length[n]]) == max(paths, key=paths.get)
        z = math.log(sum(map(math.exp, paths.values())))
        total += z
        for p, v in paths.items():
            for a, b in zip(p, p[1:]):
                expected_moves[a, b] += math.exp(v - z)
        first = np.zeros(k)
        for p, v in paths.items():
            first[p[0]] += math.exp(v - z)
        assert np.allclose(first, labels[n, 0])
    assert math.isclose(norm, total) and np.allclose(moves, expected_moves)


def plain_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "x@y.z", "1", "255", "256", "+1", " ", "  ", "-", "(", ")", "4111111111111111", "\n", "é", "5555 5555 5555 4444", ".1.2", "@@", "%"]), max_size=14))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    found = pii._find(pii.Field(), iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]))
    assert next(found).column("spans").to_pylist() == [pii.told(plain_pii(text))]


def test_personal_data_held_out_and_edges(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chains = pii.training_chains(docs)
    model = pii.train(chains[::2])
    hits = misses = extra = 0
    for text, guessed in zip(chains[1::2], pii.decode(model, chains[1::2])):
        want = set(pii.base_spans(text))
        hits, misses, extra = hits + len(want & set(guessed)), misses + len(want - set(guessed)), extra + len(set(guessed) - want)
    assert hits / (hits + misses) >= 0.8 and hits / (hits + extra) >= 0.9
    got = {(r["doc_id"], r["spans"]) for r in pii.personal_data(frame(llm), model=model).collect()}
    assert (1, "") in got and (2, "") in got and any("email:43:49,ip:50:58" in s for i, s in got if i == 10)
    assert pii.personal_data(frame(llm).where("false")).count() == 0


# 3 token counts


def test_token_counts_equal_the_library(llm):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Merges(path)
    rng = np.random.default_rng(3)
    texts = [t or "" for _, t in TEXTS] + ["<|endoftext|>", "a<|endoftext|>\n b", "0123456789" * 300, " " * 999, "a\u0558b \u0558", "\U000323b0x 1\U00011de0"]
    texts += ["".join(map(chr, rng.integers(1, 0xD7FF, 60))) for _ in range(60)] + ["".join(rng.choice(list("ab'sétm 1\n\t\x85\x1c!"), 80)) for _ in range(60)]
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r["n_tokens"]: r for r in bpe.token_counts(frame(llm, [(1, None), (2, "the " * 1100)])).collect()}
    assert got[0]["n_bytes"] == 0 and not got[0]["over_limit"] and max(got) > 1024 and got[max(got)]["over_limit"]


# 4 URLs


def test_url_parts_rules_and_scores(llm):
    given = ["http://a.NET/x", None, "no scheme", "ftp://b.example.net/en/1?q", "http://example.com/de/2#f", "x://www.example.org/fr/3", "http://net", "http://ORG?x=/fr/", "http://é.org/fr/é", "a://b://c/d", "http://xnet/y", ""] + [f"http://h{i}.net/p{i}" for i in range(40)] + [f"http://h{i}.example.net/en/p{i}" for i in range(40)]
    pages = llm.createDataFrame([(i, u, "h", "p") for i, u in enumerate(given + given[:3])], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(given) + 3
    parts = {(h, p) for h, p in map(plain_urls.split, given)}
    fold = {(r["host"], r["path"]): r["f"] for r in llm.createDataFrame(sorted(parts), "host string, path string").withColumn("f", urls.fold()).collect()}
    counts = Counter(map(plain_urls.split, given + given[:3]))
    norm = lambda k: re.sub("[0-9]", "0", "".join(k))
    train = {"allow": [], "block": []}
    for k, n in counts.items():
        verdict = plain_urls.rule_of(*k)[1]
        if verdict and fold[k]:
            train[verdict].append((norm(k), n))
    models = [plain_urls.Model(train[v]) for v in ("allow", "block")]
    for i, u in enumerate(given):
        k = plain_urls.split(u)
        rule, verdict = plain_urls.rule_of(*k)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*k, rule)
        if verdict:
            assert got[i]["verdict"] == verdict
        else:
            assert abs(got[i]["score"] - plain_urls.score(norm(k), *models)) < 2e-6
    assert urls.judge(pages.where("false")).count() == 0


def test_url_models_tell_held_out_labels_apart(llm):
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = urls.ruled(urls.parted(pages.select("page_id", "url"))).where("ruled is not null").select("host", "path", "ruled").distinct().withColumn("n", F.lit(1)).withColumn("fold", F.pmod(F.xxhash64("path"), F.lit(3)))
    scores = urls.scored(rows.where("fold = 0").select("host", "path").distinct(), rows.where("fold <> 0")).join(rows, ["host", "path"])
    right = scores.where("(score >= 0) = (ruled = 'allow')").count()
    assert right / scores.count() >= 0.9


# 5 archive records


def test_archive_records(llm, tmp_path):
    html = "<html><head><title>T &amp; x</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;b&gt; &#233;&#0;&amp;lt;<script>no()</script><a href='/x'>link</a></p>tail"
    pages = llm.createDataFrame([(1, "http://a/\r\nb", html), (2, None, None), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    derived = warc.derivatives(warc.responses(pages), keep=["page_id"])
    rows = derived.collect()
    assert len(rows) == 8
    by = {(r["page_id"], r["type"]): r for r in rows}
    assert by[1, "conversion"]["block"] == "T & x\nOne\ntwo <b> é\ufffd&lt;link\ntail"
    assert by[1, "metadata"]["refers_to"] == by[1, "conversion"]["refers_to"] and "outlink: /x\r\n" in by[1, "metadata"]["block"] and "source-header-content-type: text/html" in by[1, "metadata"]["block"]
    import hashlib

    for r in rows:
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    assert by[1, "conversion"]["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert len({r["record_id"] for r in rows}) == 6
    out = str(tmp_path / "warc")
    warc.write(derived.coalesce(1), out)
    data = b"".join(open(os.path.join(out, f), "rb").read() for f in os.listdir(out) if f.startswith("part"))
    parsed = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        parsed.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], data[:n].decode()))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    assert sorted(parsed) == sorted((r["record_id"], r["refers_to"], r["block"]) for r in rows)


def test_character_references_of_text_and_links(llm):
    html = "<p>&#x27;a&#X2019; &rsquo;&ldquo;&eacute;&uuml;&amp;uuml; &nosuch; &#xD800;&#x110000;<a href='/x?a=1&amp;b=&#x41;'>l</a>"
    row = llm.createDataFrame([(html,)], "html string").select(warc.plain_text(F.col("html")).alias("text"), warc.links(F.col("html")).alias("links")).first()
    assert row["text"] == "'a’ ’“éü&uuml; &nosuch; \ufffd\ufffdl" and row["links"] == ["/x?a=1&b=A"]


# 6 near duplicates


def test_near_duplicates_equal_brute_force(llm):
    rng = np.random.default_rng(6)
    base = [prose(i, 150).split() for i in range(100, 104)]
    rows = [r for r in TEXTS if r[1] != "another text with this id"]
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = f"w{int(rng.integers(0, 10**6))}"
        rows.append((100 + i, " ".join(words)))
    docs = frame(llm, rows)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]

    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    sets = [shingled(t) for _, t in texts]
    df = Counter(s for c in sets for s in c)
    least = max(2, math.ceil(near.FREQUENT * len(texts)))
    weight = lambda s, c: c * ((1 + min(1, math.log(len(texts) / df[s]) / math.log(1 / near.FREQUENT))) / 2 if df[s] >= least else 1)
    weighted = [{s: weight(s, c) for s, c in x.items()} for x in sets]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = sum(min(v, weighted[b][s]) for s, v in weighted[a].items() if s in weighted[b])
        whole = sum(weighted[a].values()) + sum(weighted[b].values()) - both
        if whole and both / whole >= 0.8 - 1e-12:
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(texts[i][0])
    expected = sorted(tuple(sorted(g, key=str)) for g in groups.values())
    got = near.near_duplicates(docs)
    found = {}
    for r in got.collect():
        found.setdefault(r["class_id"], []).append(r)
    # rows without words are classes of their own
    assert sum(r["kept"] for g in found.values() for r in g) == len(expected)
    assert sorted(tuple(sorted((r["doc_id"] for r in g), key=str)) for g in found.values()) == sorted(tuple(sorted(g, key=str)) for g in expected)
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(expected)
    assert near.near_duplicates(docs.where("false")).count() == 0


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    shared, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 150, 150))
    w = rng.uniform(0.5, 3.0, 1000)
    sides = []
    for own, lo in ((one, 700), (two, 850)):
        h = np.concatenate([shared, own])
        order = np.argsort(h)
        sides.append(near.samples(h[order], np.zeros(len(h), np.int64), np.concatenate([w[:700], w[lo : lo + 150]])[order])[0])
    expected = w[:700].sum() / w.sum()
    assert abs((sides[0] == sides[1]).mean() - expected) < 0.2
    assert (sides[0] == near.samples(np.sort(np.concatenate([shared, one])), np.zeros(850, np.int64), np.ones(850))[0]).mean() < 1


def test_components_of_chains_and_stars(llm):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 30)] + [(3, 3), (None, 4), (8, 3)]
    got = {r["node"]: r["root"] for r in components(llm.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 3 for i in range(5, 30)) and 3 not in got
    assert components(llm.createDataFrame([], "u long, v long")).count() == 0


def test_block_similarities_are_exact():
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e a b c d e a b c d e", "x y z u v w"]
    import pyarrow as pa

    weights = near.Weights(np.empty(0, np.uint64), np.empty(0, np.int64), 4)
    rows = next(near._vectors(weights, iter([pa.RecordBatch.from_pydict({"node": [0, 1, 2, 3], "text": texts})]))).to_pylist()
    got = near.similarities(rows, rows)
    count = lambda t: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = count(a), count(b)
            assert abs(got[i, j] - sum((x & y).values()) / sum((x | y).values())) < 1e-9


# 7 mixing


def test_mixing_meets_weights_limits_and_wholeness(llm):
    rows = [(i, prose(i, 40 if i % 10 else 80)) for i in range(600)]
    docs = llm.createDataFrame([(i, t, "big" if i < 500 else "mid" if i < 580 else None) for i, t in rows] + [(900, None, "none"), (901, "", "none")], "doc_id long, text string, source string")
    table = mixing.shares(mixing.counted(docs))
    a = mixing.exponent(table, 1.0, 3.0)
    p = np.array([r["share"] for r in table.collect() if r["share"]])
    spread = lambda x: (p ** (x - 1)).max() / (p ** (x - 1)).min()
    assert spread(a + 1e-5) <= 3.0 + 1e-3 < spread(a - 1e-2) + 1e-2
    flat = mixing.exponent(table, 0.9, 1e9)
    entropy = lambda x: -sum(q * math.log(q) for q in p**x / (p**x).sum()) / math.log(len(p))
    assert abs(entropy(flat) - 0.9) < 1e-3
    mixed = mixing.mix(docs, entropy=1.0, repeats=3.0).collect()
    uses = Counter((r["doc_id"], r["copy"]) for r in mixed)
    assert max(uses.values()) == 1 and {d for d, _ in uses} == {i for i, _ in rows} | {900, 901}
    assert max(c for _, c in uses) <= 2 and {c for (d, c) in uses if d < 500} == {0}
    assert sorted((r["block"], r["position"]) for r in mixed) == [(b, i + 1) for b, n in sorted(Counter(r["block"] for r in mixed).items()) for i in range(n)]
    assert mixing.mix(docs.where("false")).count() == 0
    small = mixing.mix(docs, entropy=1.0, repeats=1e9, budget=3_000).collect()
    by = Counter()
    for r in small:
        by[r["source"]] += r["n_tokens"]
    assert all(abs(by[s] - 1000) <= 80 for s in ("big", "mid", None))


# 8 decontamination


def test_decontamination_finds_copies_and_paraphrases_only(llm):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(["ka", "mo", "ti", "su", "ve", "an", "re", "lo"], int(rng.integers(2, 5)))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(15, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "two words")]
    rows, truth = [(1000 + i, None if i == 0 else "" if i == 1 else text(int(rng.integers(5, 900)))) for i in range(120)], set()
    for i, item in items[:60]:
        rows.append((i, f"{text(int(rng.integers(0, 200)))} {item} {text(int(rng.integers(0, 200)))}"))
        truth.add((i, i))
        words = item.split()
        for at in range(2, len(words) - 6, 4):
            words[at] = text(1)
        rows.append((200 + i, f"{text(50)} {' '.join(words)} {text(50)}"))
        truth.add((200 + i, i))
    docs = llm.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, item_id string")
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth) and {(i, i) for i in range(60)} <= got
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in got})
    assert decontaminate.matches(docs.where("false"), benchmark).count() == 0 and decontaminate.matches(docs, benchmark.where("false")).count() == 0


def test_decontamination_misses_no_copy_of_a_large_benchmark(llm):
    rng = np.random.default_rng(18)
    vocabulary = ["".join(rng.choice(["ka", "mo", "ti", "su", "ve", "an", "re", "lo"], int(rng.integers(2, 5)))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(15, 60)))) for i in range(1200)]
    rows = [(i, f"{text(int(rng.integers(100, 400)))} {item} {text(int(rng.integers(100, 400)))}") for i, item in items[::3]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items[::3]}


def test_lookup_proposes_every_place_of_enough_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "LOOKED_UP", 50)
    rng = np.random.default_rng(28)
    df = rng.integers(1, 50, 400)
    words = [rng.integers(0, 400, int(rng.integers(5, 40))) for _ in range(60)]
    items = [decontaminate.Item(w, len(w), {}, int(np.sum(df[w] < 30)), {}, 0, {}) for w in words]
    postings = decontaminate.postings_of(items, df)
    numbers = np.concatenate([x for w in words for x in (rng.integers(-1, 400, 150), w, rng.integers(-1, 400, 70))])
    found = list(decontaminate.looked_up(postings, numbers))
    at = 0
    for i, w in enumerate(words):
        at += 150
        assert any(j == i and lo <= at and at + len(w) <= hi for j, lo, hi in found)
        at += len(w) + 70


def plain_matches(docs, items, df, n_docs, terms, middle):
    """All passages of all documents against all windows of all items, whole rows, no index."""
    weight = np.append((np.log((n_docs + 1) / (df + 1)) + 0.01) ** decontaminate.IDF_POWER, middle)
    out = set()
    numbers = lambda t: terms.numbers(decontaminate.words_of(TextBatch.of([t])).hashes)
    for item_id, text in items:
        own = numbers(text)
        content = [int(x) for x in own if df[x] < decontaminate.COMMON * n_docs]
        answer = own[-decontaminate.ANSWER_WORDS :].tolist()
        item = decontaminate.Item(own, len(own), decontaminate.masks_of(own.tolist()), len(content), decontaminate.masks_of(content), len(answer), decontaminate.masks_of(answer))
        if len(own) < decontaminate.LEAST_WORDS:
            continue
        for doc_id, whole in docs:
            words = numbers(whole)
            for start in range(0, max(len(words) - decontaminate.HALF, 1), decontaminate.HALF):
                if decontaminate.held(item, words[max(0, start - len(own)) : start + 2 * decontaminate.HALF + len(own)].tolist()) is None:
                    continue
                if decontaminate.whole_cosine(words[start : start + 2 * decontaminate.HALF], own, weight**2) >= decontaminate.COSINE:
                    out.add((doc_id, item_id))
                    break
    return out


def planted(seed: int, n_items: int, n_docs: int):
    """Items, and documents that hold a copy or a paraphrase of one; words as rare as in prose."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["".join(rng.choice(["ka", "mo", "ti", "su", "ve", "an", "re", "lo"], int(rng.integers(2, 6)))) for _ in range(4000)])
    share = 1 / np.arange(3, 4003)
    text = lambda n: " ".join(rng.choice(vocabulary, int(n), p=share / share.sum()))
    items = [(i, text(rng.integers(12, 60))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        words = items[i * 7 % n_items][1].split()
        for at in range(int(rng.integers(2, 5)), len(words) - 5, int(rng.integers(3, 6))) if i % 2 else []:
            words[at] = text(1)
        docs.append((i, f"{text(rng.integers(0, 150))} {' '.join(words)} {text(rng.integers(0, 150))}"))
    return items, docs


@pytest.mark.parametrize("n_items", [40, 450])
def test_decontamination_equals_brute_force(llm, n_items):
    items, docs = planted(n_items, n_items, 60)
    hashes = decontaminate.words_of(TextBatch.of([t for _, t in items])).hashes
    terms = decontaminate.Terms(hashes)
    seen = [np.unique(terms.numbers(decontaminate.words_of(TextBatch.of([t])).hashes)) for _, t in docs]
    df = np.bincount(np.concatenate([x[x >= 0] for x in seen]), minlength=terms.size).astype(float)
    weight = (np.log((len(docs) + 1) / (df + 1)) + 0.01) ** decontaminate.IDF_POWER
    expected = plain_matches(docs, items, df, len(docs), terms, np.median(weight[terms.numbers(hashes)]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) >= 45 and len(got & expected) >= 0.95 * len(expected) and len(got - expected) <= 0.05 * len(expected)
    # tied and repeated items are matched each
    again = decontaminate.matches(llm.createDataFrame(docs[:4], "doc_id long, text string"), llm.createDataFrame([(1, items[0][1]), (1, items[0][1]), (2, items[0][1])], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in again.collect()) == [(0, 1), (0, 1), (0, 2)]


def test_the_pipeline_fits_its_benchmark_spaces_on_all_rows(llm, monkeypatch):
    import corpus_pipeline

    docs = llm.createDataFrame([(i, prose(i, 30)) for i in range(2_600)], "doc_id long, text string")
    given, real = [], decontaminate.fit
    monkeypatch.setattr(decontaminate, "fit", lambda texts, groups: given.append(texts.count()) or real(texts, groups))
    assert dict(corpus_pipeline.STAGES)["benchmark_decontamination"](llm, docs, SF).columns == docs.columns and given == [2_600]


def test_passages_without_weight_enough_are_left_out_only_if_none_can_match():
    """The bound on a passage's cosine holds for words that stand several times, in texts of one and more halves."""
    items, docs = planted(31, 30, 40)
    texts = [x for _, x in docs] + [f"{items[3][1]} {items[3][1].split()[0]} " * 2, items[4][1], "one", " ".join(items[5][1].split()[:3] * 9)]
    hashes = decontaminate.words_of(TextBatch.of([x for _, x in items])).hashes
    terms = decontaminate.Terms(hashes)
    df = np.random.default_rng(1).integers(1, 40, terms.size).astype(float)
    weight = (np.log(41 / df) + 0.01) ** decontaminate.IDF_POWER
    rows = [{"item_id": i, "text": x, "answer": None} for i, x in items]
    group, = decontaminate.groups_of(rows, terms, weight, df, np.median(weight))
    index = decontaminate.index_of(group, terms, 40, np.linalg.qr(np.random.default_rng(2).standard_normal((terms.size, 64)))[0])
    batch = TextBatch.of(texts)
    words = decontaminate.words_of(batch)
    passages, numbers = decontaminate.Passages.of(words), terms.numbers(words.hashes)
    lengths = decontaminate.passage_lengths(batch, terms, group.weight)
    norms = np.linalg.norm(decontaminate.passage_matrix(batch, terms, group.weight[:-1], np.eye(terms.size)), axis=1)
    at, windows = passages.repeats(numbers)
    squares = np.append(index.squares[:-1], 0)[numbers].astype(float)
    assert np.allclose(passages.sums(squares[:, None])[:, 0] + 2 * np.bincount(windows, squares[at], minlength=len(norms)), norms**2, rtol=1e-4)
    some = decontaminate._reaching(index, numbers, passages, lengths, (at, windows))
    whole = passages.looked_up(numbers, index.rows)
    assert np.allclose(passages.looked_up(numbers, index.rows, some), whole[some], atol=1e-5) and 0 < len(some)
    cosine = (whole / np.maximum(lengths, np.linalg.norm(whole, axis=1, keepdims=True)) @ index.windows.T).max(axis=1)
    assert set(np.flatnonzero(cosine >= decontaminate.COSINE)) <= set(some)


@pytest.mark.parametrize("most", [4_096, 200, 0])
def test_decontamination_fits_its_spaces_on_all_documents(llm, monkeypatch, most):
    """The spaces are the leading vectors of the passages of every document; they were fitted on a sample of 2,000 documents."""
    items, docs = planted(30, 70, 100)
    docs = [*docs, *((5_000 + i, prose(i, 40)) for i in range(2_500))]
    monkeypatch.setattr(decontaminate, "GRAM_TERMS", most)
    fitted, real = [], decontaminate.fit
    monkeypatch.setattr(decontaminate, "fit", lambda texts, groups: fitted.append((texts.count(), groups, out := real(texts, groups))) or out)
    table = llm.createDataFrame(docs, "doc_id long, text string").repartition(5)
    decontaminate.matches(table, llm.createDataFrame(items, "item_id long, text string"))
    (n, groups, found), = fitted
    assert n == len(docs) and len(groups) == 2
    for g, vectors in zip(groups, found):
        own, theirs = (decontaminate.product(TextBatch.of(texts), g.terms, g.weight, np.eye(g.terms.size), True) for texts in (g.texts, [x for _, x in docs]))
        whole = own[1] / own[0] + decontaminate.DOC_SHARE * theirs[1] / theirs[0]
        best = np.linalg.eigvalsh(whole)[::-1][: decontaminate.DIMENSIONS].sum()
        kept = np.trace(vectors.T @ whole @ vectors)
        assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-6) and kept == pytest.approx(best, rel=1e-3 if g.terms.size <= most else 0.03)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(-1, 4), max_size=20))
def test_common_subsequence(item, text):
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common(decontaminate.masks_of(item), len(item), text) == table[-1][-1]


# 9 secrets


def test_secrets_equal_plain_version_and_masking(llm):
    extra = [
        (30, "id ABCDEFGH12345678 key aB3dE6gH9jK2mN5pQ8rT1vW4 at db.example.com:5432\nABCDEFGH12345678 alone"), (31, "secret=token:abcdefgh token = 'éabc' API-KEY"),
        (32, "https://x.y/z?a=1 and é password: hunter22\nAKIA" + "A" * 20 + " deadbeef" * 4), (33, "pass" * 3000 + "token=abcdef " * 500), (34, "ABCDEFGH12345678" + " far" * 80 + " aB3dE6gH9jK2mN5pQ8rT1vW4"),
        (35, "x" + "0a" * 30 + "\n" + "10.0.0.1:80 " + "f" * 30),
    ]
    docs = frame(llm, TEXTS + extra)
    expected = sorted((secret_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    assert rows_of(secrets.digests(docs)) == expected
    masked = {r["doc_id"]: r for r in secrets.masked(docs).collect()}
    assert masked[30]["text"] == "id [secret] key [secret] at [secret]\n[secret] alone" and masked[30]["n_chars"] == len(masked[30]["text"])
    assert masked[1]["text"] is None and masked[4]["text"] == prose(4)
    assert secrets.digests(docs.where("false")).count() == 0 and secrets.masked(docs).columns == docs.columns


def test_secrets_take_time_in_proportion_to_the_text(llm):
    import time

    t0 = time.time()
    rows = [(1, "x" * 1_000_000), (2, "a." * 300_000 + " :80"), (3, "0123456789abcdefABCDEF+/" * 20_000 + " https://h.x"), (4, "1.1.1.1" * 50_000 + ":8"), (5, "a://" * 50_000)]
    assert secrets.digests(frame(llm, rows)).count() == 5 and time.time() - t0 < 60


def test_pipeline_masks_parts_on_neighbouring_lines(llm):
    import corpus_pipeline

    rows = [(1, "KEY_ID: ABCDEFGH12345678\nKEY: aB3dE6gH9jK2mN5pQ8rT1vW4\nAT: db.example.com:5432"), (2, "ABCDEFGH12345678" + "\nfar" * 80 + "\naB3dE6gH9jK2mN5pQ8rT1vW4")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_stage(llm, frame(llm, rows), SF).collect()}
    assert got == {1: "KEY_ID: [secret]\nKEY: [secret]\nAT: [secret]", 2: rows[1][1]}


# 10 licenses


def test_licenses(llm):
    rows = [
        (1, "Some prose. Licensed under the Apache License, Version 2.0."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "cc by cc by"), (4, "Licensed under CC BY-NC 4.0."),
        (5, "the apache spoke of a license and of version 2 of the 0"), (6, "All\nrights, reserved!"), (7, None), (8, ""), (9, "MIT License " * 3000), (9, "MIT License " * 3000), (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ]
    got = {r["doc_id"]: r for r in licenses.licenses(frame(llm, rows)).collect()}
    assert got[1]["base_labels"] == "apache" and got[1]["labels"] == "apache,apache-2.0" and got[1]["first_word"] == 5 and got[1]["score"] == 1
    assert got[2]["labels"] == "gpl,gpl-3.0" and got[4]["labels"] == "cc-by,cc-by-nc-4.0" and got[3]["n_base"] == 2 and got[3]["last_word"] == 2
    assert got[5]["labels"] == "" and got[6]["labels"] == "all-rights-reserved" and got[9]["n_base"] == 3000 and got[10]["labels"] == "mit"
    assert got[7]["n_words"] == got[8]["n_words"] == 0 and got[7]["first_word"] is None and got[7]["score"] == 0
    assert licenses.licenses(frame(llm, rows).where("false")).count() == 0


def test_license_starts_do_not_hang_on_one_rare_word():
    index = licenses.Index()
    apache = next(t for t in index.templates if t.label == "apache-2.0")
    for text in ("We are licensed by the state. Distributed under the Apache License, Version 2.0", "Distributed under the Apache License, Version 2.0. " + "words " * 50 + "licensed"):
        batch = TextBatch.of([text])
        numbers = index.terms.numbers(licenses.words_of(batch).hashes)
        idf = np.zeros(index.terms.size)
        fits = [licenses.fit_of(apache, numbers, idf)]
        for word in ("licensed", "under", "version"):
            rarest = idf.copy()
            rarest[index.terms.numbers(np.array([hash_word(word)], dtype=np.uint64))] = 9
            fits.append(licenses.fit_of(apache, numbers, rarest))
        assert all(abs(f - 7 / 8) < 1e-9 for f in fits), fits


# null and repeated ids


def test_null_and_repeated_ids_are_ids_like_others(llm):
    one, two, item = prose(61, 150), prose(62, 150), " ".join(f"item{i}" for i in range(30))
    changed = lambda t, *at: " ".join("changed" if i in at else w for i, w in enumerate(t.split()))
    rows = [(None, one), (None, one), (1, changed(one, 70)), (2, two), (2, changed(two, 20)), (None, changed(two, 90)), (3, prose(63)), (3, prose(64))]
    docs = frame(llm, rows)
    assert Counter(r["kept"] for r in near.near_duplicates(docs).collect()) == {True: 4, False: 4}
    kept = near.deduplicated(docs).collect()
    assert len(kept) == 4 and sum(r["doc_id"] == 3 for r in kept) == 2 and sum(r["doc_id"] == 2 for r in kept) < 2
    told = frame(llm, [(None, f"{one} {item} {two}"), (None, two), (4, f"{two} {item}"), (4, one), (5, one)])
    for item_id in (None, 7):
        benchmark = llm.createDataFrame([(item_id, item)], "item_id long, text string")
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(told, benchmark).orderBy("doc_id").collect()] == [(None, item_id), (4, item_id)]
        assert rows_of(decontaminate.clean(told, benchmark).select("doc_id", "text")) == sorted([(None, two), (4, one), (5, one)], key=str)
    parts = "id ABCDEFGH12345678 key aB3dE6gH9jK2mN5pQ8rT1vW4"
    hidden = frame(llm, [(None, parts), (6, parts), (6, "no part")])
    assert rows_of(secrets.digests(hidden)) == sorted((secret_row(i, t) for i, t in [(None, parts), (6, parts), (6, "no part")]), key=str)
    assert rows_of(secrets.masked(hidden).select("doc_id", "text")) == sorted([(None, "id [secret] key [secret]"), (6, "id [secret] key [secret]"), (6, "no part")], key=str)


# registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_clusters", "op12_whitening"}))
def test_registered_queries_cover_their_tables(llm, name):
    rows = QUERIES[name](llm, SF).collect()
    source = "pages" if name.startswith(("op4", "op5")) else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    whole = {r[0] for r in llm.read.parquet(f"{SF}/{source}.parquet").select(key).collect()}
    found = {r[key] for r in rows}
    assert found <= whole if name.startswith("op8") else found == whole


def test_pipeline_takes_effect_stage_by_stage(llm, tmp_path):
    import corpus_pipeline

    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(llm, before, SF).write.parquet(str(tmp_path / name))
        docs = llm.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality_rules":
            expected = {r["doc_id"] for r in quality.quality(before, quality.RULES).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == expected
        if name == "near_duplicates":
            assert docs.count() == near.near_duplicates(before).select("class_id").distinct().count()
        if name == "benchmark_decontamination":
            assert decontaminate.matches(docs, llm.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "secret_scans":
            assert docs.count() == before.count() and secrets.secrets(docs).count() == 0
        if name == "mixing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(llm, SF).count() == docs.count()
