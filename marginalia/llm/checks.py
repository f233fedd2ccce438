"""SQL that computes the rows of registered queries in another way."""

from __future__ import annotations

from marginalia.llm import secrets, warc

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
line_facts AS (
    SELECT rid, sum(c - 1)::BIGINT AS dups, sum(c)::BIGINT AS n
    FROM (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL)
    GROUP BY rid
),
windows AS (SELECT rid, i, words[i:i+2] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
covered AS (
    SELECT rid, count(DISTINCT i + o)::BIGINT AS n
    FROM (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2), (SELECT unnest([0, 1, 2]) AS o)
    GROUP BY rid
),
f AS (
    SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.dups, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
        length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, coalesce(list_max(list_transform(words, lambda x: strlen(x))), 0) AS longest
    FROM w LEFT JOIN line_facts l ON l.rid = w.rid LEFT JOIN covered c ON c.rid = w.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines
        OR n_upper > 0.5 * (n_upper + n_lower) OR n_digits > 0.3 * word_chars OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR longest > 1000) AS kept
FROM f
"""


def _bisection(passes: int = 5, parts: int = 32, entropy: str = "0.98", repeats: str = "2.0") -> str:
    """Chained search for the largest exponent below which the weights are flat enough or repeat too often."""
    steps, lo = [], "0.0::DOUBLE"
    for i in range(1, passes + 1):
        width = f"(1.0 / {parts ** i})::DOUBLE"
        before = f"(SELECT lo FROM step{i - 1})" if i > 1 else lo
        steps.append(f"""
step{i} AS (
    SELECT coalesce(max(a), any_value(base)) AS lo FROM (
        SELECT base, CASE WHEN ln(sum(p)) - sum(p * ln(p)) / sum(p) >= {entropy} * ln(count(*)) - 1e-12 OR max(p / share) / min(p / share) > {repeats} + 1e-12 THEN a END AS a
        FROM (SELECT base, base + {width} * k AS a, share, pow(share, base + {width} * k) AS p FROM shares, (SELECT {before} AS base), range(1, {parts}) t(k) WHERE share > 0)
        GROUP BY base, a
    )
)""")
    return ",".join(steps)


MIXING = (
    r"""
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
shares AS (SELECT source, tokens, tokens / sum(tokens) OVER () AS share FROM (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY source)),"""
    + _bisection()
    + r""",
weighted AS (SELECT *, w / sum(w) OVER () AS weight FROM (SELECT *, pow(share, round((SELECT lo FROM step5), 6)) AS w FROM shares)),
budget AS (SELECT max(tokens / weight) AS b FROM weighted),
quotas AS (SELECT source, tokens, greatest(tokens, round(weight * b)::BIGINT) AS quota, greatest(1, ceil(b / 100000))::BIGINT AS blocks FROM weighted, budget),
uses AS (
    SELECT doc_id, r.source, n_tokens, tokens, quota, blocks, quota // tokens AS whole, quota % tokens AS rest, copy,
        ('0x' || substr(md5('permute:' || copy || ':' || doc_id), 1, 13))::BIGINT AS draw
    FROM rows_ r JOIN quotas q ON q.source = r.source, LATERAL (SELECT unnest(range(0, quota // tokens + CASE WHEN quota % tokens > 0 THEN 1 ELSE 0 END)) AS copy)
),
runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY draw, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM uses),
blocked AS (
    SELECT doc_id, source, n_tokens, copy::BIGINT AS copy, least(floor((copy * tokens + start) / quota * blocks)::BIGINT, blocks - 1) AS block
    FROM runs WHERE copy < whole OR start < rest
)
SELECT *, row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5('block:' || copy || ':' || doc_id), 1, 13))::BIGINT, doc_id, copy) AS position FROM blocked
"""
)


def _derivatives() -> str:
    """Text and metadata blocks again, with the same fixed lists but by another engine's functions."""
    text = "regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for name in ("script", "style", "noscript", "template"):
        text = f"regexp_replace({text}, '(?is)<{name}(?:\\s[^>]*)?>.*?(?:</{name}\\s*>|\\z)', '', 'g')"
    text = f"regexp_replace({text}, '(?i)</?(?:{'|'.join(warc.BLOCKS)})(?:[\\s/][^>]*)?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for name, sign in list(warc.REFERENCES.items())[1:]:
        text = f"replace({text}, '&{name};', chr({ord(sign)}))"
    text = f"replace({text}, '&amp;', '&')"
    text = f"regexp_replace({text}, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')"
    text = f"regexp_replace({text}, '\\x20?\\n[\\x20\\n]*', chr(10), 'g')"
    text = f"trim({text}, ' ' || chr(10))"
    end = "chr(13) || chr(10)"
    uuid = "('<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>')"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5('response|' || page_id || '|' || url) AS h FROM pages),
r AS (SELECT page_id, url, html, {uuid} AS source, 'sha256:' || sha256(html) AS source_digest, strlen(html) AS size FROM p),
b AS (
    SELECT *, 'conversion' AS type, {text} AS block FROM r
    UNION ALL
    SELECT *, 'metadata', 'source-record-id: ' || source || {end} || 'source-target-uri: ' || url || {end} || 'source-date: 1970-01-01T00:00:00Z' || {end}
        || 'source-payload-digest: ' || source_digest || {end} || 'source-payload-length: ' || size || {end}
        || 'title: ' || trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title', 1), '\\s+', ' ', 'g')) || {end}
        || 'source-header-content-length: ' || size || {end} || 'source-header-content-type: text/html; charset=utf-8' || {end}
        || array_to_string(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"''>]*)["'']', 1), lambda x: 'outlink: ' || x || {end}), '')
    FROM r
),
i AS (SELECT *, md5(type || '|' || source) AS h FROM b)
SELECT page_id, type, {uuid} AS record_id, source AS refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS date,
    CASE type WHEN 'conversion' THEN 'text/plain; charset=utf-8' ELSE 'application/warc-fields' END AS content_type,
    strlen(block)::BIGINT AS content_length, source_digest, 'sha256:' || sha256(block) AS block_digest
FROM i
"""


DERIVATIVES = _derivatives()


def _secrets() -> str:
    """Places of matches from their gaps, and links by a join on documents."""
    patterns = {
        "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "identifier": "[A-Z0-9]{16,}", "secret": "[A-Za-z0-9+/_=-]{24,}", "endpoint": secrets.ENDPOINT,
    }
    hits = []
    for kind, pattern in patterns.items():
        quoted = pattern.replace("'", "''")
        group = 2 if kind == "assign" else 0
        hits.append(f"""SELECT rid, '{kind}' AS kind, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(p) AS part, unnest(g[1:len(h)]) AS gap
    FROM (SELECT rid, regexp_extract_all(t, '{quoted}') AS h, regexp_extract_all(t, '{quoted}', {group}) AS p, string_split_regex(t, '{quoted}') AS g FROM d)""")
    union = "\n    UNION ALL ".join(hits)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({union}),
placed AS (
    SELECT rid, kind, part, length(hit) AS size, sum(length(gap) + length(hit)) OVER w - length(hit) AS s, sum(length(gap) + length(hit)) OVER w AS e
    FROM hits WINDOW w AS (PARTITION BY rid, kind ORDER BY i)
),
found AS (
    SELECT *, list_position(['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'], kind) AS rank FROM placed
    WHERE CASE kind WHEN 'assign' THEN length(part) >= 6 WHEN 'access' THEN size >= 20 WHEN 'hex' THEN size >= 24
        WHEN 'identifier' THEN regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[0-9]') AND NOT starts_with(part, 'AKIA')
        WHEN 'secret' THEN regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[0-9]') ELSE true END
),
linked AS (
    SELECT w.rid, w.kind, w.s, w.e, w.rank FROM found w JOIN found o ON o.rid = w.rid AND o.s <= w.e + 200 AND o.e >= w.s - 200
    WHERE w.rank > 3 GROUP BY ALL
    HAVING bool_or((o.s >= w.e OR o.e <= w.s) AND (w.kind || '-' || o.kind) IN ('identifier-secret', 'identifier-assign', 'identifier-hex', 'secret-identifier', 'secret-endpoint', 'secret-access', 'endpoint-secret', 'endpoint-assign', 'endpoint-hex'))
        AND NOT bool_or(o.s < w.e AND o.e > w.s AND o.rank <= 3)
),
told AS (SELECT rid, kind, s, rank, kind || ':' || s || ':' || e AS x FROM (SELECT rid, kind, s, e, rank FROM found WHERE rank <= 3 UNION ALL SELECT * FROM (SELECT rid, kind, s, e, rank FROM linked)))
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (rank <= 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN told USING (rid) GROUP BY rid, doc_id
"""


SECRETS = _secrets()


def _urls() -> str:
    """Rules and models of order 6, an order at a time."""
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    columns = ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for k in range(1, 7) for c in ("a", "sa", "ta", "b", "sb", "tb"))

    def steps(x: str) -> str:
        lines, before = [], "(1 / 256.0::DOUBLE)"
        for k in range(1, 7):
            lines.append(f"CASE WHEN s{x}{k} > 0 THEN ({x}{k} + t{x}{k} * {before}) / (s{x}{k} + t{x}{k}) ELSE {before} END AS p{x}{k}")
            before = f"p{x}{k}"
        return ", ".join(lines)

    text = "repeat(chr(2), 5) || regexp_replace(host || path, '[0-9]', '0', 'g') || chr(3)"
    windows = "unnest(list_transform(range(1, length(text) - 4), lambda i: substr(text, i, 6)))"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest
),
judged AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM parts),
keys AS (SELECT host, path, ruled, count(*) AS n, ('0x' || substr(md5(host || ' ' || path), 1, 8))::BIGINT % 5 AS fold, {text} AS text FROM judged GROUP BY host, path, ruled),
seen AS (SELECT w, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b
    FROM (SELECT ruled, n, {windows} AS w FROM keys WHERE ruled IS NOT NULL AND fold <> 0) GROUP BY w),
grams AS (SELECT k, substr(w, 7 - k) AS g, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM seen, range(1, 7) t(k) GROUP BY ALL),
contexts AS (SELECT k, substr(g, 1, k - 1) AS c, sum(a) AS sa, sum(b) AS sb, (count(*) FILTER (a > 0))::DOUBLE AS ta, (count(*) FILTER (b > 0))::DOUBLE AS tb FROM grams GROUP BY k, c),
asked AS (SELECT DISTINCT {windows} AS w FROM keys WHERE ruled IS NULL OR fold = 0),
orders AS (
    SELECT w, t.k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, coalesce(ta, 0) AS ta, coalesce(tb, 0) AS tb
    FROM asked CROSS JOIN range(1, 7) t(k) LEFT JOIN grams ON grams.k = t.k AND g = substr(w, 7 - t.k) LEFT JOIN contexts ON contexts.k = t.k AND c = substr(w, 7 - t.k, t.k - 1)
),
wide AS (SELECT w, {columns} FROM orders GROUP BY w),
scores AS (SELECT w, round((ln(pa6) - ln(pb6)) * 1000000)::BIGINT AS m FROM (SELECT w, {steps('a')}, {steps('b')} FROM wide)),
keyed AS (SELECT host, path, sum(m)::DOUBLE / count(*) / 1000000 AS score FROM (SELECT host, path, {windows} AS w FROM keys WHERE ruled IS NULL OR fold = 0) JOIN scores USING (w) GROUP BY host, path),
bins AS (SELECT greatest(-200, least(200, floor(score / 0.02::DOUBLE)))::INT AS bin, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b
    FROM keys JOIN keyed USING (host, path) WHERE fold = 0 AND ruled IS NOT NULL GROUP BY bin),
gains AS (SELECT e, coalesce(sum(a) FILTER (bin >= e), 0) / sum(a) + coalesce(sum(b) FILTER (bin < e), 0) / sum(b) AS gain FROM bins, range(-200, 201) t(e) GROUP BY e),
edge AS (SELECT coalesce(round(min(e) * 0.02::DOUBLE, 6), 0) AS e FROM gains WHERE gain >= (SELECT max(gain) FROM gains) - 1e-12)
SELECT page_id, judged.host, judged.path, rule, coalesce(ruled, CASE WHEN score >= edge.e THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN ruled IS NULL THEN round(score, 6) END AS score
FROM judged CROSS JOIN edge LEFT JOIN keyed ON keyed.host = judged.host AND keyed.path = judged.path
"""


URLS = _urls()
