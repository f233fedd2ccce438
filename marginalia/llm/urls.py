"""URL filters: host and path rules, and for the rest a ratio of two character language models.

The rules label URLs. Two variable-order Markov models, of allowed and of blocked URLs, are counted over all labelled
URLs but the held-out fold. A model's probability of a character after a context is interpolated from
order 0 up to ``ORDER - 1`` (Witten-Bell: an order counts as much as it has seen, a shorter one as often as new
characters came up); a context never seen leaves the shorter one's value as it is. The score of a URL is the mean over its characters of
the difference of log-likelihoods. The held-out fold sets the threshold: the one of best balanced accuracy.

URLs are read as ``host + path``, lower-cased A-Z, digits as 0, with marks at both ends. All of it is joins and sums over
``(window)``: the ``ORDER`` characters that end at a place. Equal URLs and equal windows are one row before
anything is looked up, so the tables that are joined grow with the distinct windows; a window that
very many URLs share is a skewed join key, which Spark splits. Nothing is broadcast but single rows. Scores are
summed in whole millionths, so order doesn't matter.

Cases: a null URL or one without ``://`` has an empty host and path: no rule fits, the models judge it;
without labelled URLs of both sorts every score is 0 and the threshold 0: allowed; repeated rows are each judged; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

#: fixed values: verdict, host and path of the rules
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: characters of a window: the predicted one and its context
ORDER = 6
#: characters that order -1 takes to be equally likely
ALPHABET = 256
#: one fold of so many is held out to set the threshold
FOLDS = 5
#: bins of scores for the threshold, and their width
BINS, WIDTH = 200, 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def parted(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return urls.withColumn("host", F.translate(raw, UPPER, LOWER)).withColumn("path", path)


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``urls(host, path)`` with the longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for sort, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, sort).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", verdict)


def fold() -> Column:
    """Fold of a URL, drawn from its host and path."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", "host", "path")), 1, 8), 16, 10).cast("long") % FOLDS


def _windows(keys: DataFrame) -> DataFrame:
    """A row for each place of each URL: its window, without marks beyond the first."""
    text = F.concat(F.lit(START * (ORDER - 1)), F.regexp_replace(F.concat("host", "path"), "[0-9]", "0"), F.lit(END))
    return keys.select("*", F.explode_outer(F.transform(F.sequence(F.lit(1), F.length(text) - (ORDER - 1)), lambda i: text.substr(i, F.lit(ORDER)))).alias("window"))


def counted(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``window, allowed, blocked`` the counts of grams of every order, and of their contexts with the number of different characters."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substring("window", F.lit(ORDER + 1) - k, F.lit(ORDER)))
    grams = windows.select(F.explode_outer(suffixes).alias("gram"), "allowed", "blocked").groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    grams = cut_lineage(grams)
    context = F.col("gram").substr(F.lit(1), F.length("gram") - 1)
    contexts = grams.groupBy(context.alias("context"), F.length("gram").alias("size")).agg(
        F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"), F.count_if(F.col("allowed") > 0).alias("new_allowed"), F.count_if(F.col("blocked") > 0).alias("new_blocked")
    )
    return grams, contexts.drop("size")


def window_scores(windows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``window, score`` (millionths of a nat) of every distinct window."""
    sizes = F.sequence(F.lit(1), F.lit(ORDER))
    asked = windows.select("window").distinct().select("window", F.explode_outer(F.transform(sizes, lambda k: F.substring("window", F.lit(ORDER + 1) - k, F.lit(ORDER)))).alias("gram"))
    asked = asked.withColumn("context", F.col("gram").substr(F.lit(1), F.length("gram") - 1)).withColumn("size", F.length("gram"))
    found = asked.join(grams, "gram", "left").join(contexts, "context", "left")
    names = ["allowed", "all_allowed", "new_allowed", "blocked", "all_blocked", "new_blocked"]
    orders = found.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("size", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in names]))).alias("orders"))

    def likelihood(sort: str) -> Column:
        def step(p: Column, x: Column) -> Column:
            return F.when(x[f"all_{sort}"] > 0, (x[sort] + x[f"new_{sort}"] * p) / (x[f"all_{sort}"] + x[f"new_{sort}"])).otherwise(p)

        return F.log(F.aggregate("orders", F.lit(1.0 / ALPHABET), step))

    return orders.select("window", F.round((likelihood("allowed") - likelihood("blocked")) * 1_000_000).cast("long").alias("score"))


def scored(keys: DataFrame, labelled: DataFrame) -> DataFrame:
    """``host, path, score``: mean difference of log-likelihoods of distinct ``keys(host, path)``, the models counted on ``labelled(host, path, ruled, n)``."""
    n = F.col("n")
    seen = _windows(labelled).groupBy("window").agg(F.sum(F.when(F.col("ruled") == "allow", n).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", n).otherwise(0)).alias("blocked"))
    grams, contexts = counted(seen)
    contexts = cut_lineage(contexts)
    places = _windows(keys)
    scores = window_scores(places, grams, contexts)
    return places.join(scores, "window").groupBy("host", "path").agg((F.sum("score") / F.count(F.lit(1)) / 1_000_000).alias("score"))


def threshold(held: DataFrame) -> float:
    """Score from which a URL is allowed: best balanced accuracy on ``held(score, ruled, n)``, the lowest of equal ones; at most ``2 * BINS + 1`` rows come to the driver."""
    at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / F.lit(WIDTH)))).cast("int")
    found = held.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("allow"), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("block")).collect()
    bins = {r["bin"]: (r["allow"], r["block"]) for r in found}
    allow, block = (sum(b[i] for b in bins.values()) for i in (0, 1))
    if not allow or not block:
        return 0.0
    best, kept, dropped = (-1.0, 0.0), allow, 0
    for edge in range(-BINS, BINS + 1):
        gain = kept / allow + dropped / block
        if gain > best[0] + 1e-12:
            best = (gain, edge * WIDTH)
        kept, dropped = kept - bins.get(edge, (0, 0))[0], dropped + bins.get(edge, (0, 0))[1]
    return round(best[1], 6)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; the score is null where a rule decides."""
    rows = ruled(parted(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))), rules)
    distinct = cut_lineage(rows.groupBy("host", "path", "rule", "ruled").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", fold()))
    labelled = distinct.where("ruled is not null")
    wanted = distinct.where("ruled is null or fold = 0").select("host", "path")
    scores = cut_lineage(scored(wanted, labelled.where("fold <> 0").select("host", "path", "ruled", "n")))
    limit = threshold(labelled.where("fold = 0").join(scores, ["host", "path"]).select("score", "ruled", "n"))
    # a URL that a rule decides needs no score; equal URLs may be very many, so the distinct side is the small one
    open_scores = scores.join(distinct.where("ruled is null").select("host", "path"), ["host", "path"], "left_semi")
    judged = rows.join(open_scores, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
