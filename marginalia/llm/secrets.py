"""Secret scans with multipart credential linking, in DataFrame functions only.

A pattern's matches and the gaps between them, both arrays of a text, give every match's place by running sums
of their lengths; only texts with matches give rows, and the texts stay where they are. Places are code
points, ends exclusive.

Strong parts stand by themselves: assignments of a password or token, access identifiers, long hex runs. Weak
parts are telling only together: bare identifiers, bare secrets and endpoints. A scope is the whole text, as the parts of a
credential mostly stand on neighbouring lines, or with ``lines=True`` one line; within it weak
parts are joined by interval with the complementary parts at most ``REACH`` code points away:

=============  ====================================================
weak part      is reported if it meets
=============  ====================================================
identifier     a secret (weak or strong)
secret         an identifier or an endpoint (weak) or an access identifier
endpoint       a secret (weak or strong)
=============  ====================================================

The join key is (document, scope, stretch of ``REACH`` code points); a part is sent to the stretches that it
covers, its partners also to those within reach. Parts of one kind do not overlap, so a stretch holds a bounded
number of each kind, and the pairs of a long document grow with its length, not with its square.

A weak part that overlaps a strong one is that one.

Every pattern takes time in proportion to the text: an endpoint's scheme has at most 32 characters, a host at most nine labels of
63, so that no run without a sign is walked again from each of its characters; texts without a sign are not searched for it.

Cases: null ids are ids like others; null, empty and blank texts have no parts; a document without parts still gets its row of zeros and
empty strings; repeated rows are each reported; an empty table gives no rows; of two parts that begin
together the kind listed first comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

#: fixed values: base patterns; a match must also have ``least`` characters (of group 2 for assignments)
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: the runs of ``[0-9a-f]+`` of 24 characters or more
HEX_RUN = r"[0-9a-f]{24,}"
#: weak parts: an upper-case identifier, a mixed secret, a host or address with a port or a scheme
IDENTIFIER = r"[A-Z0-9]{16,}"
SECRET = r"[A-Za-z0-9+/_=-]{24,}"
ENDPOINT = r"(?:[a-z][a-z0-9+.-]{0,31}://[A-Za-z0-9._~:@/?&=%-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5})"
#: every endpoint has one of these
SIGN = r":(?://|[0-9]{2})"
#: kinds in the order in which equal starts are listed
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
BASE = KINDS[:3]
REACH = 200
#: a text without a match of these has no part
GATES = [r"(?i:password|passwd|secret|token|api_?key)", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"[A-Z0-9]{16}", r"[A-Za-z0-9+/_=-]{24}"]
#: what a weak part must meet
PARTNERS = {"identifier": ["secret", "assign", "hex"], "secret": ["identifier", "endpoint", "access"], "endpoint": ["secret", "assign", "hex"]}
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX_RUN, 0), "identifier": (IDENTIFIER, 0), "secret": (SECRET, 0), "endpoint": (ENDPOINT, 0)}
MASK = "[secret]"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """For every match: characters and line ends before it since the last one, its characters, and its group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), groups.alias("part"))
    fields = F.transform(
        zipped,
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), (F.length(x["gap"]) - F.length(F.replace(x["gap"], F.lit("\n"), F.lit("")))).alias("lines"),
            F.length(x["hit"]).alias("size"), x["part"].alias("part"),
        ),
    )
    present = text.rlike(pattern)
    return F.when(text.rlike(SIGN) & present if pattern == ENDPOINT else present, fields)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, mark, text``: an id with several texts has a mark for each."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, kind, scope, start, end, part``: strong and weak parts of every distinct text."""
    keyed = _keyed(docs, key, text).where(reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in GATES]))
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), *PATTERNS[k]).alias("hits")) for k in KINDS]), lambda x: x["hits"].isNotNull())
    by_kind = keyed.select("doc_id", "mark", F.explode_outer(kinds).alias("k")).where("k is not null")
    hits = by_kind.select("doc_id", "mark", "k.kind", F.posexplode_outer("k.hits").alias("n", "hit")).where("hit is not null").select("doc_id", "mark", "kind", "n", "hit.*")
    # equal rows of a table have equal parts: one of each
    hits = hits.repartition("doc_id", "mark", "kind").dropDuplicates(["doc_id", "mark", "kind", "n"])
    before = W.partitionBy("doc_id", "mark", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before)).withColumn("scope", F.sum("lines").over(before)).withColumn("start", F.col("end") - F.col("size"))
    part, wide = F.col("part"), F.col("size")
    good = (
        F.when(F.col("kind") == "assign", F.length(part) >= 6).when(F.col("kind") == "access", wide >= 20).when(F.col("kind") == "hex", wide >= 24)
        .when(F.col("kind") == "identifier", part.rlike("[A-Z]") & part.rlike("[0-9]") & ~part.startswith("AKIA"))
        .when(F.col("kind") == "secret", part.rlike("[A-Z]") & part.rlike("[a-z]") & part.rlike("[0-9]")).otherwise(True)
    )
    return placed.where(good).select("doc_id", "mark", "kind", "scope", "start", "end", "part")


def linked(found: DataFrame, lines: bool = False) -> DataFrame:
    """Weak parts of ``parts`` that have a complementary part in reach (of the same line, if ``lines``), with the kinds that they meet."""
    if not lines:
        found = found.withColumn("scope", F.lit(0).cast("long"))
    stretch = lambda at: F.floor(at / F.lit(REACH))
    weak = found.where(F.col("kind").isin(KINDS[3:])).withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end")))))
    other = found.select(F.col("doc_id").alias("other_id"), F.col("mark").alias("other_mark"), F.col("scope").alias("other_scope"), *[F.col(c).alias("other_" + c) for c in ("kind", "start", "end")])
    other = other.withColumn("stretch", F.explode(F.sequence(stretch(F.col("other_start") - REACH), stretch(F.col("other_end") + REACH)))).withColumnRenamed("stretch", "other_stretch")
    # a null id is an id like others
    same = weak["doc_id"].eqNullSafe(F.col("other_id")) & (F.col("mark") == F.col("other_mark")) & (F.col("scope") == F.col("other_scope")) & (F.col("stretch") == F.col("other_stretch"))
    met = weak.join(other, same).where(f"other_start <= end + {REACH} and other_end >= start - {REACH}")
    apart = (F.col("other_start") >= F.col("end")) | (F.col("other_end") <= F.col("start"))
    fits = F.lit(False)
    for kind, partners in PARTNERS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("other_kind").isin(partners))
    summed = met.groupBy("doc_id", "mark", "kind", "scope", "start", "end").agg(
        F.array_sort(F.collect_set(F.when(apart & fits, F.col("other_kind")))).alias("partners"),
        F.max(~apart & F.col("other_kind").isin(BASE)).alias("strong"),
    )
    return summed.where((F.size("partners") > 0) & ~F.col("strong")).drop("strong")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: bool = False) -> DataFrame:
    """``doc_id, mark, kind, start, end, partners``: strong parts, and weak ones that are linked."""
    found = cut_lineage(parts(docs, key, text))
    strong = found.where(F.col("kind").isin(BASE)).select("doc_id", "mark", "kind", "start", "end", F.array().cast("array<string>").alias("partners"))
    return strong.unionByName(linked(found, lines).select("doc_id", "mark", "kind", "start", "end", "partners"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row of ``docs``: counts of the strong kinds, hash of their places, and all places."""
    found = secrets(docs, key, text)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = F.concat_ws(":", "kind", "start", "end")
    grouped = found.groupBy("doc_id", "mark").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), told.alias("told")))).alias("spans"),
    )
    join = lambda items: F.array_join(F.transform(items, lambda x: x["told"]), ",")
    strings = grouped.select("doc_id", "mark", *[f"n_{k}" for k in BASE], join(F.filter("spans", lambda x: x["rank"] <= len(BASE))).alias("base"), join(F.col("spans")).alias("spans"))
    every = _keyed(docs, key, text).select("doc_id", "mark")
    same = every["doc_id"].eqNullSafe(strings["doc_id"]) & (every["mark"] == strings["mark"])
    return every.join(strings, same, "left").select(
        every["doc_id"], *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars", lines: bool = False) -> DataFrame:
    """``docs`` with every secret replaced by ``MASK``; a column ``size`` is set to the new length where text changed."""
    found = secrets(docs, key, text, lines)
    before = W.partitionBy("doc_id", "mark").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    joined = found.withColumn("new", F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1)))
    joined = joined.withColumn("island", F.sum("new").over(W.partitionBy("doc_id", "mark").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    islands = joined.groupBy("doc_id", "mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = islands.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_cuts")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = docs.join(cuts, docs[key].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_mark")), "left")
    from_to = F.transform(F.col("_cuts"), lambda x, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("_cuts", i.cast("int"))["end"]).alias("a"), x["start"].alias("b")))
    pieces = F.transform(from_to, lambda x: F.concat(whole.substr((x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), F.lit(MASK)))
    rest = whole.substr((F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(whole))
    out = both.withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    if size and size in docs.columns:
        out = out.withColumn(size, F.when(F.col("_cuts").isNull(), F.col(size)).otherwise(F.length(text).cast(docs.schema[size].dataType)))
    return out.select(*docs.columns)
