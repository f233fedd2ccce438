"""Tokenisers and token-set similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.basics import all_matches, bind, col

# These word lists must equal the published behaviour for the
# results to agree, so they are stated here as they are.
RETRIEVAL_STOPWORDS = """
a an and are as at be by for from has have he her him his i if in is it its
of on or that the their them they this to was were will with you your
""".split()

MATCH_STOPWORDS = """
that this with from have been will were they them than then also into only some
such each both very more most over under does what when where which their there
these those would could should about after before between across through other
within system based using used need does page pages paper papers source sources
""".split()

MATCH_DOMAIN_STOPWORDS = """
optical iris tetra vault model cache inference disaggregation gpu llm scale
design cost data
""".split()

QUERY_STOPWORDS = """
that this with from have been will were they them than then also into only some
such each both very more most over under does what when where which their there
these those would could should about after before between across through other
within system based using used need page pages paper papers source sources how
why who and the for not but all any new via can its has had was are per see
""".split()

QUERY_DOMAIN_STOPWORDS = """
optical iris tetra vault model cache inference disaggregation gpu llm scale
design cost data system method work result results approach analysis study show
shows propose proposed present presented novel deep large high
""".split()

OVERLAP_STOPWORDS = """
a an the and or of in on to for with by from is are was were be been this that
it its we our which what how why
""".split()

REASON_STOPWORDS = """
a an the and or but in on at to for of with is it its this that are was were be
been by from as not do did has have had will would could should may might can
more also we they their our you he she his her which who what how when where
there these those than then into over about after based using used via new two
one all each other such while both only see per authors itself much help doesn
papers thesis graduate schools relevant focus topic
""".split()

REASON_DOMAIN_STOPWORDS = """
optical inference model llm gpu source paper arxiv research work result results
show shows approach method methods system systems data performance evaluation
analysis study propose proposed present presented novel high large deep neural
network networks learning training test benchmark memory compute efficient
framework
""".split()

#: letters, digits and underscore of any script, inner apostrophes and hyphens kept
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]*"
ALNUM_PATTERN = r"[a-z0-9]+"
# End of the fixed values.


def _keep(words: Column, min_len: int, stops: list[str]) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*stops))


def alnum_words(c: Column | str) -> Column:
    """Lower-cased ASCII letter/digit runs, repeats kept."""
    return all_matches(F.lower(col(c)), ALNUM_PATTERN, 0)


def retrieval_terms(c: Column | str) -> Column:
    """Index and query terms: any script, repeats kept, one-letter words dropped."""
    words = F.transform(all_matches(c, WORD_PATTERN, 0), lambda w: F.lower(w))
    return _keep(words, 2, RETRIEVAL_STOPWORDS)


def ranking_terms(c: Column | str) -> Column:
    return _keep(alnum_words(c), 4, MATCH_STOPWORDS)


def matching_terms(c: Column | str) -> Column:
    """Token set used when gaps are matched with directions."""
    return F.array_distinct(_keep(alnum_words(c), 4, MATCH_STOPWORDS + MATCH_DOMAIN_STOPWORDS))


def query_terms(c: Column | str) -> Column:
    return _keep(alnum_words(c), 4, QUERY_STOPWORDS + QUERY_DOMAIN_STOPWORDS)


def overlap_terms(c: Column | str) -> Column:
    return F.array_distinct(_keep(alnum_words(c), 3, OVERLAP_STOPWORDS))


def claim_terms(c: Column | str) -> Column:
    return F.array_distinct(alnum_words(c))


def reason_keywords(c: Column | str) -> Column:
    return F.array_distinct(_keep(alnum_words(c), 4, REASON_STOPWORDS + REASON_DOMAIN_STOPWORDS))


def blank_split_keywords(c: Column | str) -> Column:
    """Words longer than two letters; punctuation and repeats stay."""
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: F.length(w) > 2)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard_or_zero(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; two empty sets are unrelated."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(_shared(a, b) / union)


def jaccard_or_one(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; two empty sets are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(_shared(a, b) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(_shared(a, b) / smaller)


def word_pairs(words: Column) -> Column:
    """Neighbouring pairs joined by a space."""
    return bind(
        words,
        lambda w: F.zip_with(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
            F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    )


def term_counts(words: Column) -> Column:
    """``array<struct<term, tf>>`` of a row's words, without a shuffle.

    Sorting the words puts repeats next to each other; the start of every run
    then gives both the term and, with the next start, how often it occurs.
    """
    def runs(w: Column) -> Column:
        n = F.size(w)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)),
        )
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(w, start - 1).alias("term"),
                    (F.coalesce(F.get(s, k + 1), n + 1) - start).cast("bigint").alias("tf"),
                ),
            ),
        )

    empty = F.expr("cast(array() as array<struct<term:string,tf:bigint>>)")
    return bind(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(empty))


def count_in(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of ``piece`` in ``text``."""
    removed = F.length(F.replace(text, piece, F.lit("")))
    return F.when(F.length(piece) == 0, F.lit(0)).otherwise(
        ((F.length(text) - removed) / F.length(piece)).cast("bigint")
    )


def substring_score(path: Column, content: Column, keywords: Column) -> Column:
    """Occurrences of every keyword in path and content, five more per path hit."""
    def folded(pair: Column) -> Column:
        return F.aggregate(
            keywords,
            F.lit(0).cast("bigint"),
            lambda acc, k: acc
            + count_in(pair["body"], k)
            + F.when(F.contains(pair["path"], k), F.lit(5)).otherwise(F.lit(0)),
        )

    return bind(F.struct(F.lower(path).alias("path"), F.lower(content).alias("body")), folded)
