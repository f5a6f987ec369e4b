"""URL normalisation and page classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmgraph.functions import dims
from firmgraph.functions.text import let, name_tokens

#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")


def normal_url(s: Column) -> Column:
    """https:// added if there is no scheme, host in lower case, no fragment and tracking; null for other schemes."""
    with_scheme = lambda x: F.when((x == "") | (x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~x.rlike("(?i)^https?://") & ~x.rlike(r"^[^/]*:\d")), None).otherwise(F.when(x.rlike("(?i)^https?://"), x).otherwise(F.concat(F.lit("https://"), x)))
    parts = lambda x: F.struct(F.lower(F.regexp_extract(x, "(?i)^(https?://[^/?]+)", 1)).alias("head"), F.regexp_extract(x, r"(?i)^https?://[^/?]+([^?]*)", 1).alias("path"), kept(F.regexp_extract(x, r"^[^?]*\?(.*)$", 1)).alias("kept"))
    kept = lambda q: F.array_join(F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKING)), "&")

    def joined(u: Column) -> Column:
        path = F.when((u["path"] == "") & (u["kept"] != ""), "/").when((u["path"] == "/") & (u["kept"] == ""), "").otherwise(u["path"])
        return F.when(u["head"] != "", F.concat(u["head"], path, F.when(u["kept"] == "", "").otherwise(F.concat(F.lit("?"), u["kept"]))))

    return let(parts(F.regexp_replace(let(F.trim(s), with_scheme), "#.*$", "")), joined)


def host(s: Column) -> Column:
    """Host of a URL, without www. and port."""
    h = F.regexp_extract(normal_url(s), r"^https?://(?:[^/?@]*@)?([^/?:]+)", 1)
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def path_of(s: Column) -> Column:
    return F.regexp_extract(s, r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def query_of(s: Column) -> Column:
    return F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1)


def canonical_key(s: Column) -> Column:
    """The key by which a crawl tells pages apart: no www., index page, closing slashes; sorted parameters."""
    base = F.regexp_replace(F.lower(F.regexp_extract(s, "(?i)^(https?://[^/?#]+)", 1)), r"://www\.", "://")
    path = F.regexp_replace(F.regexp_replace(path_of(s), r"(?i)/(index|default)\.(html?|php|aspx?)$", "/"), "/+$", "")
    query = F.array_join(F.array_sort(F.split(query_of(s), "&")), "&")
    return F.concat(base, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def root_url(s: Column) -> Column:
    head = F.regexp_extract(normal_url(s), r"^(https?://[^/?]+)", 1)
    return F.when(head != "", F.concat(head, F.lit("/")))


def is_root(s: Column) -> Column:
    return F.coalesce(let(normal_url(s), lambda n: path_of(n).isin("", "/") & (query_of(n) == "")), F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def related_site(a: Column, b: Column) -> Column:
    """Whether two URLs are of one host, or of a host and one below it."""
    return F.coalesce(let(host(a), lambda x: let(host(b), lambda y: (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)))), F.lit(False))


def is_non_official(domain: Column) -> Column:
    """Governments, listed hosts and their subdomains; a missing domain counts."""
    parts = F.split(domain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return domain.isNull() | domain.rlike(dims.GOVERNMENT_DOMAIN) | F.exists(suffixes, lambda d: d.isin(list(dims.NON_OFFICIAL_DOMAINS)))


def is_database(s: Column) -> Column:
    return s.rlike(r"\d{13}") | F.coalesce(host(s).rlike("(?i)houjin|hojin|corporate[-_]?number|corpnumber|kaisha|company[-_]?search|toukibo"), F.lit(False))


DIRECTORY_PATH = (
    r"(?i)/(company|companies|corporate|member|organization|shop|store|office|factory)[-_]?list(/|$)|/(kaiin|kaiinlist|meibo|ichiran)(/|$)|/corporations?/|/corp/[\w-]+"
    r"|/(company|corporate)/detail(/|$)|/detail/\d+|/0\d{1,4}-\d{2,4}-\d{4}(/|$)"
)


def is_directory(s: Column) -> Column:
    return path_of(s).rlike(DIRECTORY_PATH)


def is_record_page(s: Column) -> Column:
    """Whether a path segment or a parameter is an identifier."""
    identifies = lambda n: F.exists(F.split(path_of(n), "/"), lambda x: x.rlike(r"(?i)^\d{3,}(-\d+)*$|^[a-z]{1,2}\d{3,}$")) | F.exists(F.split(query_of(n), "&"), lambda p: p.rlike(r"=\d{3,}$"))
    return F.coalesce(let(normal_url(s), identifies), F.lit(False))


def is_file(s: Column) -> Column:
    return s.isNull() | s.rlike(r"(?i)\.(pdf|xlsx?|docx?|pptx?|csv|zip|rar|7z|tar|gz|jpe?g|png|gif|svg|webp|mp4|mp3)(\?|#|$)")


def site_reject_reason(s: Column) -> Column:
    """The first reason why a URL cannot be a company's own site; null if there is none."""
    reason = lambda d: (
        F.when(s.isNull() | (s == ""), "no url")
        .when(d.isNull(), "invalid url")
        .when(is_non_official(d), "non-official domain")
        .when(d.rlike(dims.JOB_BOARD_DOMAIN), "job board")
        .when(d.rlike(dims.ORGANIZATION_DOMAIN), "organisation domain")
        .when(is_database(s), "corporate database")
        .when(is_directory(s), "directory page")
        .when(is_file(s), "not html")
    )
    return let(host(s), reason)


def is_crawlable(s: Column) -> Column:
    path = path_of(s)
    return s.rlike("(?i)^https?://") & ~path.rlike(r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|css|js|ico|xml|rss)(\?|$)") & ~path.rlike(r"(?i)/(wp-admin|wp-login|cart|login|logout|admin|feed|tag|category|page/\d+)")


def domain_matches_name(name: Column, domain: Column) -> Column:
    base = F.substring_index(domain, ".", 1)
    return F.coalesce((F.length(base) >= 3) & F.exists(name_tokens(name), lambda t: F.contains(base, t) | F.contains(t, base)), F.lit(False))


def classify_page(url: Column, link_text: Column, title: Column, home: Column) -> Column:
    """struct(page_type, priority): the rule with the highest priority, ten more if URL and text both match."""
    hay = F.concat_ws(" ", F.coalesce(link_text, F.lit("")), F.coalesce(title, F.lit("")))

    def best(x: Column) -> Column:
        hits = [
            F.when(url.rlike(f"(?i){u}") | x.rlike(t), F.struct((F.lit(p) + F.when(url.rlike(f"(?i){u}") & x.rlike(t), 10).otherwise(0)).alias("priority"), F.lit(-i).alias("at"), F.lit(kind).alias("page_type")))
            for i, (kind, u, t, p) in enumerate(dims.PAGE_RULES)
        ]
        return F.coalesce(F.array_max(F.array_compact(F.array(*hits))), F.struct(F.lit(10).alias("priority"), F.lit(0).alias("at"), F.lit("other").alias("page_type")))

    top = F.regexp_replace(path_of(url), "/+$", "").rlike(r"(?i)^$|^/(index|home|top)(\.html?|\.php)?$") & same_site(url, home)
    bad = ~F.coalesce(url.rlike("(?i)^https?://."), F.lit(False))
    fixed = lambda p, kind: F.struct(F.lit(p).alias("priority"), F.lit(0).alias("at"), F.lit(kind).alias("page_type"))
    chosen = F.when(bad, fixed(0, "other")).when(top, fixed(110, "top")).otherwise(let(hay, best))
    return let(chosen, lambda c: F.struct(c["page_type"].alias("page_type"), c["priority"].alias("priority")))
