"""Vector similarity, recency, reputation and cost formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and tables that must agree with the published behaviour.
KEYWORD_WEIGHT = 0.60
RELEVANCE_WEIGHT = 0.25
RECENCY_WEIGHT = 0.15
RECENCY_HALF_LIFE_DAYS = 60
REPUTATION_WEIGHT = 0.15
REJECT_WEIGHT = 0.2
BM25_K1 = 1.5
BM25_B = 0.75
#: model name part, USD per million input tokens, per million output tokens
MODEL_RATES = (
    ("haiku", 0.80, 4.00),
    ("sonnet", 3.00, 15.00),
    ("opus", 15.00, 75.00),
    ("flash", 0.075, 0.30),
    ("gemini", 1.25, 5.00),
    ("ollama", 0.0, 0.0),
)
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}
SCOPE_RANK = {"all": 0, "wiki": 1, "research": 2, "web": 3}
STATUS_RANK = {"pending": 0, "waiting_approval": 1, "ingested": 2, "rejected": 3, "deleted": 4}
# End of the fixed values.


def rank_of(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, rank in ranks.items():
        out = F.when(value == key, F.lit(rank)).otherwise(out)
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal-length or zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norms != 0), _dot(a, b) / norms).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """Saturated, length-normalised term frequency."""
    mean = F.when(avg_dl == 0, F.lit(1.0)).otherwise(avg_dl)
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean))


def recency(published: Column, today: Column) -> Column:
    """Halves every sixty days; future dates count as today, bad ones as 0."""
    day = F.try_to_date(F.regexp_extract(F.coalesce(published, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    age = F.greatest(F.datediff(today, day), F.lit(0))
    return F.when(day.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -age / RECENCY_HALF_LIFE_DAYS))


def reputation(accept: Column, reject: Column, prior: float = 1.0) -> Column:
    """Smoothed accept share mapped to [-1, 1]."""
    return F.round(2 * (accept + prior) / (accept + reject + 2 * prior) - 1, 6)


def estimated_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost, at 8 decimals, by the first rate whose name part occurs in the model name.

    Rates are whole thousandths, so the cost is counted in whole tenths of the
    last decimal and rounding meets no binary fractions.
    """
    name = F.lower(F.coalesce(model, F.lit("")))
    tenths = F.lit(0).cast("bigint")
    for part, rate_in, rate_out in reversed(MODEL_RATES):
        tenths = F.when(
            F.contains(name, F.lit(part)), tokens_in * round(rate_in * 1000) + tokens_out * round(rate_out * 1000)
        ).otherwise(tenths)
    return F.round(tenths / 10.0) / 1e8


def composite_score(keyword: Column, relevance: Column, recent: Column) -> Column:
    return KEYWORD_WEIGHT * keyword + RELEVANCE_WEIGHT * relevance + RECENCY_WEIGHT * recent


def learned_score(base: Column, rep: Column, penalty: Column) -> Column:
    return base + REPUTATION_WEIGHT * rep - REJECT_WEIGHT * penalty
