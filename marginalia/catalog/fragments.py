"""SQL fragments shared by the checking statements (DuckDB dialect)."""

from __future__ import annotations

from marginalia.functions import tokens


def words(items: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(items)) + ")"


def retrieval_terms(text: str) -> str:
    return (
        rf"[lower(t) for t in regexp_extract_all({text}, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''\-]*')"
        f" if length(t) > 1 and lower(t) not in {words(tokens.RETRIEVAL_STOPWORDS)}]"
    )


def alnum_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def kept(text: str, min_len: int, stops: list[str]) -> str:
    return f"[t for t in {alnum_words(text)} if length(t) >= {min_len} and t not in {words(stops)}]"


def ranking_terms(text: str) -> str:
    return kept(text, 4, tokens.MATCH_STOPWORDS)


def matching_terms(text: str) -> str:
    return f"list_distinct({kept(text, 4, tokens.MATCH_STOPWORDS + tokens.MATCH_DOMAIN_STOPWORDS)})"


def query_terms(text: str) -> str:
    return kept(text, 4, tokens.QUERY_STOPWORDS + tokens.QUERY_DOMAIN_STOPWORDS)


def overlap_terms(text: str) -> str:
    return f"list_distinct({kept(text, 3, tokens.OVERLAP_STOPWORDS)})"


def reason_keywords(text: str) -> str:
    return f"list_distinct({kept(text, 4, tokens.REASON_STOPWORDS + tokens.REASON_DOMAIN_STOPWORDS)})"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def bm25(docs: str, queries: str) -> str:
    """CTEs ending in ``scored(query_id, chunk_id, raw_score)``.

    ``docs`` yields (chunk_id, text), ``queries`` yields (query_id, text).
    """
    return f"""
docs AS ({docs}),
toks AS (SELECT chunk_id, {retrieval_terms('text')} AS terms FROM docs),
lens AS (SELECT chunk_id, len(terms) AS dl FROM toks),
tot AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM lens),
posts AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS qtf
          FROM (SELECT query_id, unnest({retrieval_terms('text')}) AS term FROM ({queries})) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
scored AS (
  SELECT a.query_id, p.chunk_id,
         sum(a.qtf * ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5))
             * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / t.avg_dl))) AS raw_score
  FROM asked a JOIN dfs d USING (term) JOIN posts p USING (term) JOIN lens l USING (chunk_id), tot t
  GROUP BY ALL)"""


CANONICAL_URL = r"""
CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN
  lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
  lower(regexp_extract({u}, '://([^/?#]*)', 1)) ||
  regexp_replace(regexp_replace(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') ||
  (CASE WHEN len([p for p in string_split(regexp_extract({u}, '\?([^#]*)', 1), '&')
                 if regexp_matches(p, '^[^=]*=.+') and not regexp_matches(lower(p), '^(utm_|fbclid|gclid)')]) > 0
        THEN '?' || array_to_string([p for p in string_split(regexp_extract({u}, '\?([^#]*)', 1), '&')
                 if regexp_matches(p, '^[^=]*=.+') and not regexp_matches(lower(p), '^(utm_|fbclid|gclid)')], '&')
        ELSE '' END)
ELSE {u} END"""


def canonical_url(u: str) -> str:
    return CANONICAL_URL.format(u=u)


HREFS = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
