"""Citation checks: best excerpt of a source for a claim and its verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.basics import bind, nonblank, strip
from marginalia.functions.prose import sentences_of
from marginalia.functions.tokens import claim_terms

# Excerpt size and verdict rule.
WINDOW = 6
EXCERPT_CHARS = 2000
SUPPORT_SHARE = 0.6
VERDICTS = ["supported", "unsupported", "unclear"]
# End of the fixed values.


def _overlap(claim: Column, text: Column) -> Column:
    return F.size(F.array_intersect(claim, claim_terms(text)))


def _last_best(claim: Column, texts: Column) -> Column:
    """``struct<overlap, at>`` of the text closest to the claim; ties go to the last."""
    return F.array_max(F.transform(texts, lambda t, i: F.struct(_overlap(claim, t).alias("overlap"), i.alias("at"))))


def best_excerpt(claim: Column, source: Column, window: int = WINDOW, size: int = EXCERPT_CHARS) -> Column:
    """Sentences around the best match inside the best paragraph of the whole source."""
    def windowed(terms: Column, paragraph: Column) -> Column:
        def cut(sentences: Column) -> Column:
            def around(best: Column) -> Column:
                low = F.greatest(best["at"] - window // 2, F.lit(0))
                return strip(F.array_join(F.slice(sentences, low + 1, F.lit(window)), " "))

            return F.when(F.size(sentences) <= window, paragraph).otherwise(bind(_last_best(terms, sentences), around))

        return bind(sentences_of(paragraph), cut)

    def chosen(s: Column) -> Column:
        def pick(best: Column) -> Column:
            return F.when(best["overlap"] == 0, s["text"]).otherwise(
                windowed(s["terms"], F.get(s["paragraphs"], best["at"]))
            )

        return F.when((F.size(s["terms"]) == 0) | (F.size(s["paragraphs"]) == 0), s["text"]).otherwise(
            bind(_last_best(s["terms"], s["paragraphs"]), pick)
        )

    text = strip(F.coalesce(source, F.lit("")))
    packed = bind(
        text,
        lambda t: F.struct(
            t.alias("text"), claim_terms(claim).alias("terms"),
            nonblank(F.transform(F.split(t, r"\n{2,}"), strip)).alias("paragraphs"),
        ),
    )
    return F.substring(bind(packed, chosen), 1, size)


def support_share(claim: Column, excerpt: Column) -> Column:
    terms = claim_terms(claim)
    return bind(terms, lambda t: _overlap(t, excerpt) / F.greatest(F.size(t), F.lit(1)))


def heuristic_verdict(claim: Column, excerpt: Column) -> Column:
    return F.when(support_share(claim, excerpt) >= SUPPORT_SHARE, F.lit("supported")).otherwise(F.lit("unclear"))


def route_of(verdict: Column, reachable: Column) -> Column:
    return F.when(~reachable, "unreachable").when(verdict == "supported", "keep").otherwise("gap")


def confidence_of(verdict: Column, reachable: Column) -> Column:
    return F.when(~reachable, "low").when(verdict.isin("supported", "unsupported"), "high").otherwise("medium")


def parsed_verdict(reply: Column) -> Column:
    """Verdict of a judge's reply: its JSON object, else the strongest word in it."""
    obj = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1)
    stated = F.lower(strip(F.get_json_object(obj, "$.verdict")))
    low = F.lower(F.coalesce(reply, F.lit("")))
    return (
        F.when(stated.isin(*VERDICTS), stated)
        .when(F.contains(low, F.lit("unsupported")), "unsupported")
        .when(F.contains(low, F.lit("unclear")), "unclear")
        .when(F.contains(low, F.lit("supported")), "supported")
        .otherwise("unclear")
    )


def check_claims(claims: DataFrame, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Verdict, route and confidence of ``claims(claim_id, claim, source)``.

    ``judge(claim, excerpt)`` is a column function (for example a pandas UDF)
    that returns a reply text; without one the word overlap decides.
    """
    cut = claims.withColumn("excerpt", best_excerpt(F.col("claim"), F.col("source")))
    if judge is None:
        verdict, reachable = heuristic_verdict(F.col("claim"), F.col("excerpt")), F.lit(False)
    else:
        reply = judge(F.col("claim"), F.col("excerpt"))
        reachable = reply.isNotNull()
        verdict = F.when(reachable, parsed_verdict(reply)).otherwise(heuristic_verdict(F.col("claim"), F.col("excerpt")))
    judged = cut.withColumn("verdict", verdict).withColumn("reachable", reachable)
    return judged.select(
        "claim_id", "verdict",
        route_of(F.col("verdict"), F.col("reachable")).alias("route"),
        confidence_of(F.col("verdict"), F.col("reachable")).alias("confidence"),
        "excerpt",
        F.round(support_share(F.col("claim"), F.col("excerpt")), 6).alias("share"),
    )
