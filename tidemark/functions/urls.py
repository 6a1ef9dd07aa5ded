"""URLs: hosts, canonical forms, ids and handles. What cannot be parsed gives null, or an empty canonical form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: query parameters that only track.
TRACKING = r"^(utm_.*|fbclid|gclid|igshid|mc_.*|ref|ref_src|s|t)$"
#: Hosts and their platforms.
PLATFORM_HOSTS = {
    "x": r"(^|\.)(x|twitter)\.com$", "instagram": r"(^|\.)instagram\.com$", "linkedin": r"(^|\.)linkedin\.com$", "github": r"(^|\.)github\.com$",
    "youtube": r"(^|\.)(youtube\.com|youtu\.be)$", "product_hunt": r"(^|\.)producthunt\.com$", "hacker_news": r"^news\.ycombinator\.com$", "reddit": r"(^|\.)reddit\.com$",
}


def part(url: Column, which: str) -> Column:
    return F.try_parse_url(url, F.lit(which))


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def domain_root(url: Column) -> Column:
    """The first label of the host."""
    return F.split_part(host(url), F.lit("."), F.lit(1))


def platform_of(url: Column) -> Column:
    h, out = host(url), F.lit(None).cast("string")
    for name, pattern in reversed(PLATFORM_HOSTS.items()):
        out = F.when(h.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters, www and a last slash (but a root keeps its own); one host and path for each post; empty if it is no URL."""
    h = F.regexp_replace(host(url), r"^(mobile\.)?twitter\.com$", "x.com")
    path, query = F.coalesce(part(url, "PATH"), F.lit("")), F.coalesce(part(url, "QUERY"), F.lit(""))
    status, media = r"(?i)^/([^/]+)/status/([0-9]+).*$", r"(?i)^/(p|reel|tv)/([^/]+).*$"
    is_status, is_media, linked = (h == "x.com") & path.rlike(status), (h == "instagram.com") & path.rlike(media), h.endswith("linkedin.com")
    new_path = F.when(is_status, F.concat(F.lit("/"), F.lower(F.regexp_extract(path, status, 1)), F.lit("/status/"), F.regexp_extract(path, status, 2)))
    new_path = new_path.when(is_media, F.concat(F.lit("/"), F.lower(F.regexp_extract(path, media, 1)), F.lit("/"), F.regexp_extract(path, media, 2))).otherwise(path)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(TRACKING)), "&")
    kept = F.when(is_status | is_media | linked, F.lit("")).otherwise(kept)
    scheme = F.lower(part(url, "PROTOCOL"))
    port = F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), ":([0-9]+)$", 1)
    usual = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    h = F.when(usual, h).otherwise(F.concat(h, F.lit(":"), port))
    new_path = F.when(linked, F.regexp_replace(new_path, "/$", "")).otherwise(new_path)
    new_path = F.when(new_path.isin("", "/"), "/").otherwise(F.regexp_replace(new_path, "/$", ""))
    out = F.concat(scheme, F.lit("://"), h, new_path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.coalesce(out, F.lit(""))


def canonical_account(url: Column, handle: Column) -> Column:
    """Host and path in lower case, or the handle where the URL is none."""
    h = F.regexp_replace(host(url), r"^(mobile\.)?twitter\.com$", "x.com")
    got = F.concat(h, F.regexp_replace(F.lower(F.coalesce(part(url, "PATH"), F.lit(""))), "/+$", ""))
    return F.coalesce(F.when(got != "", got), F.regexp_replace(F.lower(handle), "^@", ""), F.lit(""))


def post_id(platform: Column, url: Column) -> Column:
    """The post's id in its URL, by platform; null where there is none."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/$", "")
    parameter = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k))
    some = lambda *p: F.coalesce(*[F.nullif(F.regexp_extract(path, "(?i)" + x, 1), F.lit("")) for x in p])
    return (
        F.when(platform == "x", some(r"/status/([0-9]+)"))
        .when(platform == "instagram", some(r"^/(?:p|reel|tv)/([^/]+)"))
        .when(platform == "linkedin", some(r"/feed/update/urn:li:activity:([0-9]+)", r"/posts/([^/]+)"))
        .when(platform == "youtube", F.coalesce(parameter("v"), some(r"/shorts/([^/]+)")))
        .when(platform == "product_hunt", some(r"/posts/([^/]+)", r"/products/([^/]+)"))
        .when(platform == "reddit", some(r"/comments/([^/]+)"))
        .when(platform == "hacker_news", parameter("id"))
    )


def handle(platform: Column, url: Column) -> Column:
    """The first path segment, the last on linkedin."""
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    got = F.when(platform == "linkedin", F.get(parts, F.size(parts) - 1)).otherwise(F.get(parts, F.lit(0)))
    return F.regexp_replace(F.lower(got), "^@", "")


def own_handle(value: Column) -> Column:
    """A handle as written by hand: lower case, no @, only its own signs."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9._-]+", ""), F.lit("-"))


def site_handle(url: Column) -> Column:
    """The handle in an address: the first path segment on github, instagram and x, the last on linkedin, else the address itself in `own_handle` form; empty if it is no URL."""
    h = F.lower(part(url, "HOST"))
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    has = lambda *names: h.rlike("|".join(n.replace(".", r"\.") for n in names))
    got = F.when(has("github.com", "instagram.com", "x.com", "twitter.com"), F.get(parts, F.lit(0))).when(has("linkedin.com"), F.get(parts, F.size(parts) - 1)).otherwise(url)
    return F.when(h.isNotNull(), own_handle(got)).otherwise(F.lit(""))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))
