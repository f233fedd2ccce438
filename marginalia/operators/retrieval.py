"""Chunk tables, the inverted index, ranked retrieval and vector rerank.

Two access paths give the same BM25 ranking:

* ``bm25_scan`` scores a chunk table directly. Term frequencies of the query
  terms are computed per row, so the only shuffle is the final top-k merge.
* ``bm25_indexed`` reads a postings table laid out by term and touches only the
  terms of the query. ``retrieve_indexed`` goes on from there: hits take their records
  from the stored chunks by id, so no text but theirs is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import frontmatter as fm
from marginalia.functions import identity, prose, scoring
from marginalia.functions.basics import bind, blank_to_null, present, strip
from marginalia.functions.tokens import retrieval_terms, term_counts
from marginalia.session import BROADCAST_ROWS, cut_lineage

#: chunks whose postings of one term share a file
SALT_CHUNKS = 250_000
#: scores are compared at this many decimals so that equal texts tie
TIE_DECIMALS = 9


def chunk_table(pages: DataFrame, size: int = prose.CHUNK_CHARS, overlap: int = prose.CHUNK_OVERLAP) -> DataFrame:
    """Chunk records of ``pages(path, text)``; one row per chunk."""
    header = r"(?s)\A---\n(.*?)\n---\n"
    head = fm.chunk_header("text")
    read = pages.select(
        F.col("path").alias("page_path"),
        F.coalesce(head["address"], identity.path_address(F.col("path"))).alias("page_address"),
        head["title"].alias("title"),
        fm.body("text", header).alias("content"),
        identity.text_hash("text").alias("page_body_hash"),
    )
    cut = read.select("*", F.posexplode_outer(prose.chunk_texts("content", size, overlap)).alias("chunk_index", "raw_text")).where(present("chunk_index"))
    prefix = prose.page_prefix(F.col("title"), F.col("content"))
    return cut.select(
        F.lit(1).alias("schema_version"),
        "page_path",
        "page_address",
        "chunk_index",
        F.concat_ws(":", "page_address", "chunk_index").alias("chunk_id"),
        "raw_text",
        F.concat(prefix, F.lit("\n\n"), F.col("raw_text")).alias("contextualized_text"),
        prefix.alias("prefix"),
        F.lit("synthetic").alias("prefix_source"),
        F.length("raw_text").alias("char_count"),
        identity.text_hash("raw_text").alias("body_hash"),
        "page_body_hash",
    )


def changed_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks whose own or page hash is not yet stored at their place."""
    return chunks.join(
        existing.select("page_address", "chunk_index", "body_hash", "page_body_hash"),
        ["page_address", "chunk_index", "body_hash", "page_body_hash"],
        "left_anti",
    )


def searchable(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text)``: the contextualised text, else the raw one."""
    return chunks.select(
        "chunk_id",
        F.coalesce(blank_to_null(F.col("contextualized_text")), F.col("raw_text"), F.lit("")).alias("text"),
    )


def term_postings(docs: DataFrame) -> DataFrame:
    """``(term, chunk_id, tf, dl)`` of ``docs(chunk_id, text)``, without a shuffle."""
    counted = docs.select("chunk_id", retrieval_terms("text").alias("terms")).select(
        "chunk_id", F.size("terms").cast("bigint").alias("dl"), term_counts(F.col("terms")).alias("counts")
    )
    return counted.select("chunk_id", "dl", F.explode_outer("counts").alias("c")).where(present("c")).select(
        F.col("c.term").alias("term"), "chunk_id", F.col("c.tf").alias("tf"), "dl"
    )


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("chunk_id", F.size(retrieval_terms("text")).cast("bigint").alias("dl"))


def corpus_size(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("doc_count"), F.avg("dl").alias("avg_dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """A posting is unique per term and chunk, so counting rows gives the df."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(docs: DataFrame) -> DataFrame:
    terms = docs.select(F.explode_outer(F.array_distinct(retrieval_terms("text"))).alias("term")).where(present("term")).distinct()
    vocabulary = terms.agg(F.count(F.lit(1)).alias("vocab_size"))
    return corpus_size(document_lengths(docs)).crossJoin(F.broadcast(vocabulary))


def write_index(docs: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Postings clustered by term, chunk lengths and corpus totals as Parquet.

    Rows are spread over ``buckets`` folders by term hash, a term of many chunks
    over as many files of its folder as the chunks ask for; files are sorted by term so that row-group
    statistics skip the others. The totals keep the number of buckets.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings = term_postings(docs).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    salts = max(8, -(-docs.count() // SALT_CHUNKS))
    (
        postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
        .sortWithinPartitions("bucket", "term", "chunk_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{folder}/postings")
    )
    document_lengths(docs).write.mode("overwrite").parquet(f"{folder}/lengths")
    totals = corpus_size(spark.read.parquet(f"{folder}/lengths")).withColumn("buckets", F.lit(buckets))
    totals.write.mode("overwrite").parquet(f"{folder}/totals")


def query_weights(spark: SparkSession, query: str) -> list[tuple[str, int]]:
    """Terms of one query text with how often each occurs in it."""
    terms = spark.range(0, 1, 1, 1).select(term_counts(retrieval_terms(F.lit(query))).alias("c"))
    return [(r["term"], int(r["tf"])) for r in terms.select(F.explode_outer("c").alias("c")).where(present("c")).select("c.*").collect()]


def bm25_indexed(spark: SparkSession, folder: str, query: str, k: int = 20) -> DataFrame:
    """Top ``k`` chunks from a written index; only the folders of the query's terms are read."""
    weights = query_weights(spark, query)
    totals = spark.read.parquet(f"{folder}/totals")
    buckets = totals.first()["buckets"]
    wanted = spark.createDataFrame(weights, "term string, qtf bigint").withColumn(
        "bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    )
    postings = (
        spark.read.parquet(f"{folder}/postings")
        .where(F.col("bucket").isin([r["bucket"] for r in wanted.select("bucket").distinct().collect()]))
        .where(F.col("term").isin([w for w, _ in weights]))
    )
    totals = F.broadcast(totals.drop("buckets"))
    dfs = document_frequencies(postings)
    weighted = F.broadcast(wanted.drop("bucket").join(dfs, "term").crossJoin(totals))
    part = F.col("qtf") * scoring.bm25_idf(F.col("doc_count"), F.col("df")) * scoring.bm25_weight(
        F.col("tf"), F.col("dl"), F.col("avg_dl")
    )
    scored = postings.join(weighted, "term").groupBy("chunk_id").agg(F.sum(part).alias("raw_score"))
    return top_scored(scored, k)


def top_scored(scored: DataFrame, k: int) -> DataFrame:
    """First ``k`` by score, ties by id; the score is rounded after ranking."""
    return (
        scored.orderBy(F.round("raw_score", TIE_DECIMALS).desc(), "chunk_id")
        .limit(k)
        .withColumn("score", F.round("raw_score", 6))
        .drop("raw_score")
    )


def bm25_scores(docs: DataFrame, query: str) -> DataFrame:
    """``(chunk_id, raw_score)`` of every chunk that holds a query term.

    A query is a handful of terms: their frequencies become columns of the scan,
    the corpus totals a one-row side.
    """
    weights = query_weights(docs.sparkSession, query)
    if not weights:
        return docs.select("chunk_id", F.lit(0.0).alias("raw_score")).where(F.lit(False))
    names = [f"tf_{i}" for i in range(len(weights))]

    words = [word for word, _ in weights]

    def occurrences(hits: Column, word: str) -> Column:
        return F.size(F.filter(hits, lambda t: t == F.lit(word))).cast("bigint")

    def frequencies(terms: Column) -> Column:
        held = F.filter(terms, lambda t: t.isin(*words))
        return bind(
            held,
            lambda hits: F.struct(
                F.size(terms).cast("bigint").alias("dl"), *[occurrences(hits, w).alias(n) for w, n in zip(words, names)]
            ),
        )

    # a few numbers a chunk, kept so that totals and scores share one pass over the texts
    rows = cut_lineage(docs.select("chunk_id", bind(retrieval_terms("text"), frequencies).alias("s")).select("chunk_id", "s.*"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.avg("dl").alias("avg_dl"),
        *[F.count_if(F.col(n) > 0).alias(f"df_{n}") for n in names],
    )
    score = F.lit(0.0)
    for (_, qtf), name in zip(weights, names):
        part = scoring.bm25_idf(F.col("doc_count"), F.col(f"df_{name}")) * scoring.bm25_weight(
            F.col(name), F.col("dl"), F.col("avg_dl")
        )
        score = score + F.when(F.col(name) > 0, qtf * part).otherwise(F.lit(0.0))
    # every idf is positive, so a chunk scores above zero exactly if it holds a term
    scored = rows.crossJoin(F.broadcast(totals)).select("chunk_id", score.alias("raw_score"))
    return scored.where(F.col("raw_score") > 0)


def bm25_scan(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    return top_scored(bm25_scores(docs, query), k)


def bm25_many(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` chunks for each of ``queries(query_id, text)``.

    Postings meet the query terms on the term. While the query terms are few
    they are broadcast, so a hot term's postings never move; beyond that the
    join is a shuffle that AQE may split. Scores are summed per (query, chunk)
    and cut to ``k`` before and after the last shuffle.
    """
    asked = queries.select("query_id", F.explode_outer(term_counts(retrieval_terms("text"))).alias("c")).where(present("c")).select(
        "query_id", F.col("c.term").alias("term"), F.col("c.tf").alias("qtf")
    )
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    postings = term_postings(docs)
    totals = F.broadcast(corpus_size(document_lengths(docs)))
    # kept, as frequencies and scores both need them
    held = cut_lineage(postings.join(hint(asked.select("term").distinct()), "term", "left_semi"))
    weighted = asked.join(document_frequencies(held), "term").crossJoin(totals).select(
        "query_id",
        "term",
        "avg_dl",
        (F.col("qtf") * scoring.bm25_idf(F.col("doc_count"), F.col("df"))).alias("weight"),
    )
    part = F.col("weight") * scoring.bm25_weight(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    scored = held.join(hint(weighted), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("raw_score"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw_score", TIE_DECIMALS).desc(), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", F.round("raw_score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
    )


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidate records of a short hit list; chunks that are gone drop out."""
    keep = chunks.select(
        "chunk_id", "page_address", "page_path", "chunk_index", "body_hash", prose.snippet("raw_text").alias("snippet")
    )
    return keep.join(F.broadcast(hits), "chunk_id").withColumnRenamed("score", "bm25_score")


def cosine_top(vectors: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` of ``vectors(id, embedding)`` for a one-row ``query(embedding)``."""
    one = F.broadcast(query.select(F.col("embedding").alias("query_embedding")).limit(1))
    scored = vectors.crossJoin(one).select(
        "id", scoring.cosine(F.col("embedding"), F.col("query_embedding")).alias("raw_score")
    )
    return (
        scored.orderBy(F.round("raw_score", TIE_DECIMALS).desc(), "id")
        .limit(k)
        .select("id", F.round("raw_score", 6).alias("rerank_score"))
    )


def rerank(candidates: DataFrame, embeddings: DataFrame | None, query: DataFrame | None, model: str = "", k: int = 5) -> DataFrame:
    """Rerank hit rows by stored vectors of ``embeddings(model, body_hash, embedding)``.

    Without vectors the order stays; a candidate without one scores 0.
    """
    order = ["rerank_score", "bm25_score"]
    if embeddings is None or query is None:
        ranked = candidates.withColumn("rerank_score", F.lit(0.0)).withColumn("rerank_source", F.lit("noop"))
    else:
        stored = embeddings.where(F.col("model") == model).select("body_hash", "embedding")
        one = F.broadcast(query.select(F.col("embedding").alias("query_embedding")).limit(1))
        # the hit list is short: it picks its vectors first, then takes them
        own = stored.join(F.broadcast(candidates.select("body_hash").distinct()), "body_hash", "left_semi")
        ranked = (
            candidates.join(own, "body_hash", "left")
            .crossJoin(one)
            .withColumn("rerank_score", scoring.cosine(F.col("embedding"), F.col("query_embedding")))
            .withColumn(
                "rerank_source",
                F.when(F.col("embedding").isNull(), F.lit("missing-vector")).otherwise(F.lit(f"cosine:{model}")),
            )
            .withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
            .drop("embedding", "query_embedding")
        )
    return ranked.orderBy(*[F.col(c).desc() for c in order], F.col("chunk_id")).limit(k)


def best_per_page(ranked: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Highest-scored row of every page, the first one on ties."""
    cols = [F.col(c) for c in ranked.columns]
    best = ranked.groupBy("page_address").agg(
        F.min_by(F.struct(*cols), F.struct(-F.round(F.col(score), TIE_DECIMALS), F.col("chunk_id"))).alias("best")
    )
    return best.select("best.*")


def retrieve(
    chunks: DataFrame,
    query: str,
    embeddings: DataFrame | None = None,
    query_vector: DataFrame | None = None,
    model: str = "",
    bm25_top: int = 20,
    top: int = 5,
    use_rerank: bool = True,
) -> DataFrame:
    """BM25 candidates, vector rerank, best chunk of every page; without an index, by a scan of the chunks."""
    hits = hydrate(bm25_scan(searchable(chunks), query, bm25_top), chunks)
    return ranked_hits(hits, embeddings, query_vector, model, top, use_rerank)


def ranked_hits(hits: DataFrame, embeddings: DataFrame | None, query_vector: DataFrame | None, model: str, top: int, use_rerank: bool) -> DataFrame:
    """Rerank of hydrated hits, best chunk of every page."""
    if use_rerank:
        final = rerank(hits, embeddings, query_vector, model, top)
    else:
        final = (
            hits.withColumn("rerank_score", F.col("bm25_score"))
            .withColumn("rerank_source", F.lit("skipped"))
            .orderBy(F.col("bm25_score").desc(), "chunk_id")
            .limit(top)
        )
    return best_per_page(final).orderBy(F.col("rerank_score").desc(), F.col("chunk_id")).limit(top)


def write_chunks(chunks: DataFrame, folder: str, parts: int | None = None) -> None:
    """Index of ``chunks`` with the chunks themselves, sorted by id so that a hit's row group is found by its statistics."""
    write_index(searchable(chunks), folder)
    parts = parts or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks.repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{folder}/chunks")


def retrieve_indexed(
    spark: SparkSession,
    folder: str,
    query: str,
    embeddings: DataFrame | None = None,
    query_vector: DataFrame | None = None,
    model: str = "",
    bm25_top: int = 20,
    top: int = 5,
    use_rerank: bool = True,
) -> DataFrame:
    """``retrieve`` over what ``write_chunks`` wrote: postings of the query's terms, then the hits' own records."""
    hits = cut_lineage(bm25_indexed(spark, folder, query, bm25_top))
    # at most ``bm25_top`` ids, which reach the scan as a filter
    ids = [r["chunk_id"] for r in hits.select("chunk_id").collect()]
    chunks = spark.read.parquet(f"{folder}/chunks").where(F.col("chunk_id").isin(ids))
    return ranked_hits(hydrate(hits, chunks), embeddings, query_vector, model, top, use_rerank)


def keyword_context(pages: DataFrame, nodes: DataFrame, question: str, k: int = 8, excerpt: int = 2000) -> DataFrame:
    """Pages and nodes with the most occurrences of the question's words."""
    from marginalia.functions.tokens import blank_split_keywords, substring_score

    words = blank_split_keywords(F.lit(question))
    page_hits = pages.select(
        "path",
        substring_score(F.col("path"), F.col("text"), words).alias("score"),
        strip(F.substring("text", 1, excerpt)).alias("excerpt"),
        F.lit("wiki").alias("source"),
    )
    node_hits = nodes.select(
        "path",
        substring_score(F.lit(""), F.col("text"), words).alias("score"),
        strip(F.substring("text", 1, excerpt)).alias("excerpt"),
        F.lit("objective").alias("source"),
    )
    return page_hits.unionByName(node_hits).where(F.col("score") > 0).orderBy(F.col("score").desc(), "path").limit(k)
