"""Tokenisers, chunks, snippets, slugs and hashes over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.functions import identity, prose, tokens
from marginalia.functions.basics import bind, long_size, present
from marginalia.operators import retrieval
from marginalia.session import read_table


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text")


def chunk_docs(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select(F.col("doc_id").alias("chunk_id"), "text")


TOKEN_COLUMNS = {
    "retrieval": (tokens.retrieval_terms, fr.retrieval_terms),
    "ranking": (tokens.ranking_terms, fr.ranking_terms),
    "matching": (tokens.matching_terms, fr.matching_terms),
    "query": (tokens.query_terms, fr.query_terms),
    "overlap": (tokens.overlap_terms, fr.overlap_terms),
    "reason": (tokens.reason_keywords, fr.reason_keywords),
}


@query(
    "token_counts",
    "SELECT doc_id, "
    + ", ".join(f"cast(len({sql('text')}) AS bigint) AS {name}_terms" for name, (_, sql) in TOKEN_COLUMNS.items())
    + ", cast(len(list_distinct(" + fr.alnum_words("text") + ")) AS bigint) AS claim_terms"
    + r", cast(len([w for w in regexp_split_to_array(lower(text), '\s+') if length(w) > 2]) AS bigint) AS blank_words"
    + " FROM documents",
)
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select(
        "doc_id",
        *[long_size(fn("text")).alias(f"{name}_terms") for name, (fn, _) in TOKEN_COLUMNS.items()],
        long_size(tokens.claim_terms("text")).alias("claim_terms"),
        long_size(tokens.blank_split_keywords("text")).alias("blank_words"),
    )


@query(
    "token_digest",
    f"SELECT doc_id, md5(array_to_string({fr.retrieval_terms('text')}, ' ')) AS digest FROM documents",
)
def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.md5(F.array_join(tokens.retrieval_terms("text"), " ")).alias("digest"))


@query(
    "bigram_counts",
    f"""WITH t AS (SELECT doc_id, {fr.query_terms('text')} AS w FROM documents),
p AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS pair FROM t)
SELECT pair, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM p GROUP BY pair HAVING count(*) >= 3""",
)
def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    pairs = docs(spark, folder).select(F.explode_outer(tokens.term_counts(tokens.word_pairs(tokens.query_terms("text")))).alias("c")).where(present("c"))
    return (
        pairs.groupBy(F.col("c.term").alias("pair"))
        .agg(F.sum("c.tf").alias("uses"), F.count(F.lit(1)).alias("docs"))
        .where("uses >= 3")
    )


@query(
    "term_frequencies",
    f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({fr.retrieval_terms('text')}) AS term FROM documents)
GROUP BY ALL""",
)
def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.term_postings(chunk_docs(spark, folder)).select(F.col("chunk_id").alias("doc_id"), "term", "tf")


@query(
    "document_frequency",
    f"""SELECT term, count(DISTINCT doc_id) AS df FROM
(SELECT doc_id, unnest({fr.retrieval_terms('text')}) AS term FROM documents) GROUP BY ALL""",
)
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequencies(retrieval.term_postings(chunk_docs(spark, folder)))


@query(
    "index_stats",
    f"""WITH t AS (SELECT doc_id, {fr.retrieval_terms('text')} AS terms FROM documents)
SELECT count(*) AS doc_count, round(avg(len(terms)), 6) AS avg_dl,
       (SELECT count(DISTINCT term) FROM (SELECT unnest(terms) AS term FROM t)) AS vocab_size FROM t""",
)
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.index_stats(chunk_docs(spark, folder)).withColumn("avg_dl", F.round("avg_dl", 6))


QUESTION = "the attention and thand of threaea ererer le que mento"
REPEATED = "the tion tion thand thand thand que"


def _bm25_top(question: str, k: int) -> str:
    cte = fr.bm25("SELECT doc_id AS chunk_id, text FROM documents", f"SELECT 0 AS query_id, '{question}' AS text")
    return f"""WITH {cte}
SELECT chunk_id, round(raw_score, 6) AS score FROM scored ORDER BY round(raw_score, 9) DESC, chunk_id LIMIT {k}"""


@query("bm25_topk", _bm25_top(QUESTION, 20))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_scan(chunk_docs(spark, folder), QUESTION, 20)


@query("bm25_repeated_terms", _bm25_top(REPEATED, 20))
def bm25_repeated_terms(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_scan(chunk_docs(spark, folder), REPEATED, 20)


@query(
    "bm25_many_queries",
    "WITH "
    + fr.bm25("SELECT doc_id AS chunk_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark")
    + """
SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, round(raw_score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 5""",
)
def bm25_many_queries(spark: SparkSession, folder: str) -> DataFrame:
    asked = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_many(chunk_docs(spark, folder), asked, 5)


@query(
    "chunk_sizes",
    r"""WITH RECURSIVE parts AS (
  SELECT doc_id, [p for p in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(body, '\n\s*\n')] if length(p) > 0] AS ps
  FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS body FROM documents)),
walk AS (
  SELECT doc_id, 0 AS i, '' AS opened, 0 AS size, cast(NULL AS varchar) AS done, ps FROM parts
  UNION ALL
  SELECT doc_id, i + 1,
         CASE WHEN size + length(ps[i + 1]) + 2 >= 2000 THEN right(joined, 200) ELSE joined END,
         CASE WHEN size + length(ps[i + 1]) + 2 >= 2000 THEN length(right(joined, 200)) ELSE size + length(ps[i + 1]) + 2 END,
         CASE WHEN size + length(ps[i + 1]) + 2 >= 2000 THEN joined END,
         ps
  FROM (SELECT *, CASE WHEN opened = '' THEN ps[i + 1] ELSE opened || chr(10) || chr(10) || ps[i + 1] END AS joined
        FROM walk WHERE i < len(ps))),
chunks AS (
  SELECT doc_id, done AS t FROM walk WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, opened FROM walk WHERE i = len(ps) AND regexp_matches(opened, '\S'))
SELECT doc_id, count(*) AS chunks, cast(sum(length(t)) AS bigint) AS chars, min(md5(t)) AS first_digest, max(md5(t)) AS last_digest
FROM chunks GROUP BY doc_id""",
)
def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences stand for paragraphs, since the texts hold no blank lines."""
    body = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    chunks = docs(spark, folder).select("doc_id", F.transform(prose.chunk_texts(body), lambda t: t).alias("t"))
    sizes = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    digests = F.transform("t", lambda x: F.md5(x))
    return chunks.where(F.size("t") > 0).select(
        "doc_id", long_size(F.col("t")).alias("chunks"), sizes.alias("chars"),
        F.array_min(digests).alias("first_digest"), F.array_max(digests).alias("last_digest"),
    )


@query(
    "chunk_records",
    r"""WITH c AS (
  SELECT doc_id, 'wiki/' || source || '/' || doc_id || '.md' AS page_path, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
k AS (
  SELECT doc_id, page_path, text, body, 0 AS chunk_index, body AS raw_text FROM c WHERE length(body) > 0
  UNION ALL
  SELECT doc_id, page_path, text, body, 1, right(body, 200) FROM c WHERE length(body) + 2 >= 2000 AND regexp_matches(right(body, 200), '\S'))
SELECT 'syn-' || left(sha1(page_path), 6) || ':' || chunk_index AS chunk_id, page_path, cast(chunk_index AS bigint) AS chunk_index,
       cast(length(raw_text) AS bigint) AS char_count,
       'sha256:' || sha256(raw_text) AS body_hash, 'sha256:' || sha256(text) AS page_body_hash,
       md5('This passage is from the wiki page "(untitled)". The page opens: '
           || left(regexp_extract(body, '(?s)^(.*?[.!?])\s+', 1)
                   || CASE WHEN regexp_matches(body, '(?s)^.*?[.!?]\s+') THEN '' ELSE body END, 300)
           || chr(10) || chr(10) || raw_text) AS digest
FROM k""",
)
def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "documents").select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text"
    )
    return retrieval.chunk_table(pages).select(
        "chunk_id", "page_path", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("char_count").cast("bigint").alias("char_count"), "body_hash", "page_body_hash",
        F.md5("contextualized_text").alias("digest"),
    )


@query(
    "chunk_incremental",
    r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
k AS (SELECT doc_id, 0 AS chunk_index FROM c WHERE length(body) > 0
      UNION ALL SELECT doc_id, 1 FROM c WHERE length(body) + 2 >= 2000 AND regexp_matches(right(body, 200), '\S'))
SELECT cast(chunk_index AS bigint) AS chunk_index, count(*) AS to_write FROM k WHERE doc_id % 3 = 0 GROUP BY ALL""",
)
def chunk_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks to write after every third page has changed since the last build."""
    table = read_table(spark, folder, "documents")
    path = F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md"))
    now = retrieval.chunk_table(table.select(path.alias("path"), "text"))
    was = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    before = retrieval.chunk_table(table.select(path.alias("path"), was.alias("text")))
    return (
        retrieval.changed_chunks(now, before)
        .groupBy(F.col("chunk_index").cast("bigint").alias("chunk_index"))
        .agg(F.count(F.lit(1)).alias("to_write"))
    )


@query(
    "snippets_and_slugs",
    rf"""SELECT doc_id,
  CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '\s+$', '') || '…' END AS snippet,
  regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 45), '-+$', '') AS gap_slug,
  coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'untitled') AS report_slug,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', ''), ''), 'item') AS node_slug,
  'sha256:' || sha256(text) AS digest
FROM documents""",
)
def snippets_and_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select(
        "doc_id",
        prose.snippet("text").alias("snippet"),
        prose.gap_slug("text").alias("gap_slug"),
        prose.report_slug("text").alias("report_slug"),
        prose.node_slug("text").alias("node_slug"),
        identity.text_hash("text").alias("digest"),
    )


@query(
    "query_phrases",
    rf"""WITH t AS (SELECT doc_id, '**[[wiki/x/' || source || '|' || source || ']]** [3]' || text AS s FROM documents),
a AS (SELECT doc_id, {fr.strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\[\\[[^\\]]*\\|([^\\]|]*)\\]\\]', '[[\\1]]', 'g'), '\\[\\[(?:[^\\]]*/)?([^\\]/]*)\\]\\]', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[[\\d\\s,\\-]+\\]', ' ', 'g'), '[*_`#>]+', ' ', 'g'), '\\s+', ' ', 'g')")} AS phrase FROM t)
SELECT doc_id, phrase, cast(length(phrase) AS bigint) AS chars FROM a""",
)
def query_phrases(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.concat(F.lit("**[[wiki/x/"), "source", F.lit("|"), "source", F.lit("]]** [3]"), "text")
    return read_table(spark, folder, "documents").select("doc_id", prose.clean_query_text(marked).alias("phrase")).select(
        "doc_id", "phrase", F.length("phrase").cast("bigint").alias("chars")
    )


@query(
    "substring_scores",
    """WITH k AS (SELECT unnest(['tion', 'the', 'src1', 'que']) AS w),
s AS (SELECT doc_id, 'wiki/' || source || '.md' AS path, source,
  (SELECT sum((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)
       + CASE WHEN contains('wiki/' || source || '.md', w) THEN 5 ELSE 0 END) FROM k) AS score, text FROM documents)
SELECT doc_id, cast(score AS bigint) AS score FROM s WHERE score > 0""",
)
def substring_scores(spark: SparkSession, folder: str) -> DataFrame:
    words = tokens.blank_split_keywords(F.lit("tion the src1 que of"))
    path = F.concat(F.lit("wiki/"), "source", F.lit(".md"))
    return (
        read_table(spark, folder, "documents")
        .select("doc_id", tokens.substring_score(path, F.col("text"), words).alias("score"))
        .where("score > 0")
    )


@query(
    "keyword_context_top8",
    """WITH k AS (SELECT unnest(['tion', 'the', 'que', 'src1']) AS w),
s AS (
 SELECT 'wiki/' || source || '/' || doc_id || '.md' AS path, 'wiki' AS source,
  (SELECT sum((length(lower(d.text)) - length(replace(lower(d.text), w, ''))) // length(w)
       + CASE WHEN contains('wiki/' || d.source || '/' || doc_id || '.md', w) THEN 5 ELSE 0 END) FROM k) AS score FROM documents d
 UNION ALL
 SELECT 'objective/' || item_id, 'objective',
  (SELECT sum((length(lower(b.text)) - length(replace(lower(b.text), w, ''))) // length(w)) FROM k) FROM benchmark b)
SELECT path, source, cast(score AS bigint) AS score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 8""",
)
def keyword_context_top8(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "documents").select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text"
    )
    nodes = read_table(spark, folder, "benchmark").select(F.concat(F.lit("objective/"), "item_id").alias("path"), "text")
    return retrieval.keyword_context(pages, nodes, "tion the que src1").select("path", "source", "score")


COSINE_SQL = """
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_cosine_similarity([cast(x AS double) for x in embedding], (SELECT [cast(x AS double) for x in e] FROM q)) AS c
      FROM embeddings)"""


@query(
    "cosine_topk",
    f"WITH {COSINE_SQL} SELECT vec_id, round(c, 6) AS rerank_score FROM s ORDER BY round(c, 9) DESC, vec_id LIMIT 5",
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "embeddings")
    vectors = table.select(F.col("vec_id").alias("id"), "embedding")
    top = retrieval.cosine_top(vectors, table.where("vec_id = 0").select("embedding"), 5)
    return top.withColumnRenamed("id", "vec_id")


@query(
    "best_vector_per_label",
    f"""WITH {COSINE_SQL}
SELECT label, vec_id, round(c, 6) AS rerank_score FROM
 (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id) AS rn FROM s) WHERE rn = 1""",
)
def best_vector_per_label(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "embeddings")
    one = F.broadcast(table.where("vec_id = 0").select(F.col("embedding").alias("q")))
    from marginalia.functions.scoring import cosine

    scored = table.crossJoin(one).select(
        F.col("label").alias("page_address"), F.col("vec_id").alias("chunk_id"),
        cosine(F.col("embedding"), F.col("q")).alias("rerank_score"),
    )
    return retrieval.best_per_page(scored).select(
        F.col("page_address").alias("label"), F.col("chunk_id").alias("vec_id"), F.round("rerank_score", 6).alias("rerank_score")
    )


_hit_cte = fr.bm25("SELECT doc_id AS chunk_id, text FROM documents", f"SELECT 0 AS query_id, '{QUESTION}' AS text")


RETRIEVE_SQL = f"""WITH {_hit_cte},
hits AS (SELECT chunk_id, raw_score FROM scored ORDER BY round(raw_score, 9) DESC, chunk_id LIMIT 20),
vec AS (SELECT h.chunk_id, h.raw_score, d.source AS page_address,
  coalesce(list_cosine_similarity([cast(x AS double) for x in e.embedding],
     (SELECT [cast(x AS double) for x in embedding] FROM embeddings WHERE vec_id = 0)), 0) AS c
  FROM hits h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN embeddings e ON e.vec_id = h.chunk_id),
top AS (SELECT * FROM vec ORDER BY c DESC, raw_score DESC, chunk_id LIMIT 5),
best AS (SELECT *, row_number() OVER (PARTITION BY page_address ORDER BY round(c, 9) DESC, chunk_id) AS rn FROM top)
SELECT page_address, chunk_id, round(raw_score, 6) AS bm25_score, round(c, 6) AS rerank_score FROM best WHERE rn = 1"""


def retrieval_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as chunks, stored vectors, and the vector of the question."""
    key = F.col("doc_id").cast("string")
    chunks = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_address"), F.col("source").alias("page_path"),
        F.lit(0).alias("chunk_index"), key.alias("body_hash"), F.col("text").alias("raw_text"),
        F.col("text").alias("contextualized_text"),
    )
    vectors = read_table(spark, folder, "embeddings")
    stored = vectors.select(F.lit("m").alias("model"), F.col("vec_id").cast("string").alias("body_hash"), "embedding")
    return chunks, stored, vectors.where("vec_id = 0").select("embedding")


@query("retrieve_pages", RETRIEVE_SQL)
def retrieve_pages(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 top 20, vector rerank to 5, best chunk per page."""
    chunks, stored, asked = retrieval_tables(spark, folder)
    found = retrieval.retrieve(chunks, QUESTION, stored, asked, "m")
    return found.select("page_address", "chunk_id", "bm25_score", F.round("rerank_score", 6).alias("rerank_score"))
