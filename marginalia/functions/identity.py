"""Stable identifiers, URL forms and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.basics import bind, blank_to_null, col, first_match, nonblank, strip

# Identifier patterns, prefixes and categories that must agree
# with the published behaviour.
ARXIV_PATTERN = r"(?i)(?:arxiv[:/ ]?)?\b(\d{4}\.\d{4,5})(?:v\d+)?\b"
DOI_PATTERN = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"
YOUTUBE_PATTERN = r"(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})"
ARXIV_LINK_PATTERN = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?"
ARXIV_TEXT_PATTERN = r"(?i)arxiv\W{0,4}(\d{4}\.\d{4,5})(?:v\d+)?"
DOI_LINK_PATTERN = r"(?i)(?:doi\.org/|\bdoi:\s*)?(10\.\d{4,9}/[^\s)\]}\"'<>]+)"
DOI_TAIL = r"[.,;:)\]}]+$"
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid")
KNOWN_ID_PREFIXES = ("arxiv", "doi", "youtube", "url", "id", "sha256", "unknown")
STEM_ARXIV_PATTERN = r"^\d{4}\.\d{4,5}(v\d+)?$"
STEM_NAME_PATTERN = r"^[A-Za-z0-9_-]{3,80}$"
ARXIV_CATEGORY_BY_ID = {
    "arxiv_cs_ar": "cs.AR",
    "arxiv_cs_dc": "cs.DC",
    "arxiv_cs_lg": "cs.LG",
    "arxiv_eess_sp": "eess.SP",
}
# End of the fixed values.


def valid_url(c: Column | str) -> Column:
    """An http or https address with a host."""
    return F.coalesce(F.rlike(col(c), F.lit(r"^(?i:https?)://[^/?#]+")), F.lit(False))


def _url_parts(url: Column) -> Column:
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    return F.struct(
        F.lower(F.regexp_extract(url, whole, 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, whole, 2)).alias("host"),
        F.regexp_extract(url, whole, 3).alias("path"),
        F.regexp_extract(url, whole, 4).alias("query"),
    )


def _kept_parameters(query: Column) -> Column:
    """Query parameters with a value that are not tracking marks."""
    def wanted(pair: Column) -> Column:
        key = F.lower(F.substring_index(pair, "=", 1))
        tracked = F.lit(False)
        for prefix in TRACKING_PREFIXES:
            tracked = tracked | F.startswith(key, F.lit(prefix))
        return F.rlike(pair, F.lit("^[^=]*=.+")) & ~tracked

    return F.filter(F.split(query, "&"), wanted)


def canonical_url(c: Column | str) -> Column:
    """Lower scheme and host, no trailing slash, tracking marks or fragment."""
    def rebuilt(p: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(p["path"], r";[^/]*$", ""), r"/+$", "")
        query = F.array_join(_kept_parameters(p["query"]), "&")
        tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
        return F.concat(p["scheme"], F.lit("://"), p["host"], path, tail)

    trimmed = strip(c)
    return F.when(
        F.rlike(trimmed, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")),
        bind(_url_parts(trimmed), rebuilt),
    ).otherwise(trimmed)


def source_identity(
    url: Column,
    haystack: Column,
    explicit: Column | None = None,
    arxiv_field: Column | None = None,
    doi_field: Column | None = None,
    content_hash: Column | None = None,
    fallback: Column | None = None,
) -> Column:
    """``struct<id, id_type, url>``: explicit > arXiv > DOI > video > url > hash.

    The whole haystack is searched.
    """
    none = F.lit(None).cast("string")
    explicit = blank_to_null(strip(explicit)) if explicit is not None else none
    arxiv_field = blank_to_null(strip(arxiv_field)) if arxiv_field is not None else none
    doi_field = blank_to_null(strip(doi_field)) if doi_field is not None else none
    content_hash = content_hash if content_hash is not None else none
    fallback = fallback if fallback is not None else F.lit("source")
    address = strip(F.coalesce(url, F.lit("")))

    def made(ident: Column, kind: str, link: Column) -> Column:
        return F.struct(ident.alias("id"), F.lit(kind).alias("id_type"), link.alias("url"))

    def chosen(f: Column) -> Column:
        link = f["address"]
        return (
            F.when(
                f["explicit"].isNotNull(),
                made(
                    F.when(F.contains(f["explicit"], F.lit(":")), f["explicit"])
                    .otherwise(F.concat(F.lit("id:"), f["explicit"])),
                    "explicit",
                    link,
                ),
            )
            .when(
                f["arxiv_field"].isNotNull(),
                made(F.concat(F.lit("arxiv:"), F.regexp_replace(f["arxiv_field"], "v[0-9]+$", "")), "arxiv", link),
            )
            .when(f["doi_field"].isNotNull(), made(F.concat(F.lit("doi:"), F.lower(f["doi_field"])), "doi", link))
            .when(
                f["arxiv"].isNotNull(),
                made(
                    F.concat(F.lit("arxiv:"), f["arxiv"]),
                    "arxiv",
                    F.coalesce(blank_to_null(link), F.concat(F.lit("https://arxiv.org/abs/"), f["arxiv"])),
                ),
            )
            .when(
                f["doi"].isNotNull(),
                made(
                    F.concat(F.lit("doi:"), F.lower(f["doi"])),
                    "doi",
                    F.coalesce(blank_to_null(link), F.concat(F.lit("https://doi.org/"), f["doi"])),
                ),
            )
            .when(
                f["video"].isNotNull(),
                made(
                    F.concat(F.lit("youtube:"), f["video"]),
                    "youtube",
                    F.coalesce(blank_to_null(link), F.concat(F.lit("https://youtu.be/"), f["video"])),
                ),
            )
            .when(link != "", made(F.concat(F.lit("url:"), canonical_url(link)), "url", link))
            .when(f["hash"].isNotNull(), made(f["hash"], "hash", link))
            .otherwise(made(F.concat(F.lit("unknown:"), f["fallback"]), "unknown", link))
        )

    return bind(
        F.struct(
            address.alias("address"),
            explicit.alias("explicit"),
            arxiv_field.alias("arxiv_field"),
            doi_field.alias("doi_field"),
            first_match(haystack, ARXIV_PATTERN).alias("arxiv"),
            first_match(haystack, DOI_PATTERN).alias("doi"),
            first_match(haystack, YOUTUBE_PATTERN).alias("video"),
            content_hash.alias("hash"),
            fallback.alias("fallback"),
        ),
        chosen,
    )


def proposed_identity(raw: Column) -> Column:
    """``struct<id, id_type, url>`` of an id or address handed to the queue."""
    def normal(r: Column) -> Column:
        prefix = F.lower(F.substring_index(r, ":", 1))
        known = F.contains(r, F.lit(":")) & prefix.isin(*KNOWN_ID_PREFIXES)
        return (
            F.when(
                known,
                F.struct(
                    r.alias("id"),
                    prefix.alias("id_type"),
                    F.when(F.startswith(r, F.lit("url:")), F.substring(r, 5, 1 << 30)).otherwise(F.lit("")).alias("url"),
                ),
            )
            .when(F.contains(r, F.lit("://")), source_identity(r, r))
            .otherwise(
                F.struct(F.concat(F.lit("id:"), r).alias("id"), F.lit("explicit").alias("id_type"), F.lit("").alias("url"))
            )
        )

    return bind(strip(F.coalesce(raw, F.lit(""))), normal)


def arxiv_identity(c: Column) -> Column:
    found = first_match(c, r"(\d{4}\.\d{4,5})")
    return F.coalesce(F.concat(F.lit("arxiv:"), found), strip(c))


def ledger_identity(c: Column) -> Column:
    """Comparison form of a ledger id: arXiv without version, DOI in lower case."""
    def normal(r: Column) -> Column:
        low = F.lower(r)
        return (
            F.when(F.startswith(low, F.lit("arxiv:")), arxiv_identity(F.substring(r, 7, 1 << 30)))
            .when(F.startswith(low, F.lit("doi:")), F.concat(F.lit("doi:"), F.lower(strip(F.substring(r, 5, 1 << 30)))))
            .otherwise(r)
        )

    return bind(strip(F.coalesce(c, F.lit(""))), normal)


def item_identity(source_id: Column, url: Column) -> Column:
    """Identity of one harvested item: global paper ids, else its address."""
    sid = F.coalesce(source_id, F.lit(""))
    address = F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", "")
    return (
        F.when(F.startswith(sid, F.lit("arxiv:")) | F.startswith(sid, F.lit("doi:")), sid)
        .when(address != "", address)
        .otherwise(sid)
    )


def seen_identity(id_type: Column, source_id: Column, url: Column) -> Column:
    sid = F.coalesce(source_id, F.lit(""))
    return F.when(F.coalesce(id_type, F.lit("url")).isin("arxiv", "doi") & (sid != ""), sid).otherwise(
        F.coalesce(blank_to_null(url), sid)
    )


def text_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(col(c), "UTF-8"), 256))


def short_file_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(content, 256), 1, 16))


def path_address(path: Column) -> Column:
    """Address of a page that names none, from its path."""
    return F.concat(F.lit("syn-"), F.substring(F.sha1(F.encode(path, "UTF-8")), 1, 6))


def looks_like_stem(title: Column) -> Column:
    """Titles that are empty, paper ids or bare file names."""
    t = strip(title)
    return (
        F.coalesce(title, F.lit("")).eqNullSafe("")
        | F.rlike(t, F.lit(STEM_ARXIV_PATTERN))
        | F.rlike(t, F.lit(STEM_NAME_PATTERN))
    )


def repo_of_url(url: Column) -> Column:
    """``owner/repo`` of a code-hosting address; a ``.git`` suffix is dropped."""
    hosted = r"github\.com[/:]([^/]+)/([^/.\s]+)"
    bare = r"^([^/\s]+)/([^/\s]+)$"
    found = F.concat_ws("/", first_match(url, hosted, 1), first_match(url, hosted, 2))
    plain = F.concat_ws("/", first_match(strip(url), bare, 1), first_match(strip(url), bare, 2))
    return F.coalesce(blank_to_null(found), blank_to_null(plain))


def doi_of_url(url: Column) -> Column:
    return first_match(url, r"doi\.org/(10\.[^?\s#]+)")


def arxiv_of_url(url: Column) -> Column:
    return first_match(url, r"arxiv\.org/abs/([0-9]+\.[0-9v]+)")


def short_title_of_url(url: Column) -> Column:
    """Host and the last two path parts."""
    def named(p: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(p["host"], r"^.*@", ""), r":\d*$", "")
        return bind(
            nonblank(F.split(p["path"], "/")),
            lambda parts: F.concat_ws(
                "/",
                F.coalesce(blank_to_null(host), url),
                blank_to_null(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")),
            ),
        )

    return bind(_url_parts(url), named)


def host_of_url(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def paper_identity(url: Column, doi: Column) -> Column:
    """``struct<id_type, source_id>`` of a paper record."""
    return bind(
        F.struct(arxiv_of_url(url).alias("arxiv"), blank_to_null(doi).alias("doi"), F.coalesce(url, F.lit("")).alias("url")),
        lambda p: F.when(
            p["arxiv"].isNotNull(),
            F.struct(F.lit("arxiv").alias("id_type"), F.concat(F.lit("arxiv:"), p["arxiv"]).alias("source_id")),
        )
        .when(p["doi"].isNotNull(), F.struct(F.lit("doi").alias("id_type"), p["doi"].alias("source_id")))
        .otherwise(F.struct(F.lit("url").alias("id_type"), p["url"].alias("source_id"))),
    )


def arxiv_category(entry_id: Column, rss_feed: Column, url: Column) -> Column:
    by_id = F.lit(None).cast("string")
    for key, value in ARXIV_CATEGORY_BY_ID.items():
        by_id = F.when(entry_id == key, F.lit(value)).otherwise(by_id)
    listed = r"/list/([A-Za-z]+\.[A-Z]+)/"
    return F.coalesce(
        by_id,
        first_match(F.coalesce(rss_feed, F.lit("")), listed),
        first_match(F.coalesce(url, F.lit("")), listed),
    )
