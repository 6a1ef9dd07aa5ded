"""Discovery of accounts and pages: whether a text or page is about an entity, targets and their order, candidates, clean-up of what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import clean
from tidemark.functions.urls import host

#: Words of a start-up, of a page that was refused, and sites of the programme itself.
CONTEXT = r"(?i)\b(YC|Y Combinator|startup|founder|co[- ]?founder|launch|product)\b"
BLOCKED = "(?i)captcha|blocked by network security|target url returned error 403|forbidden|access denied|temporarily blocked|unusual traffic|enable javascript to continue|to continue, log in"
PROGRAMME = r"(ycombinator|workatastartup)\.com$"


def root_label(url: Column) -> Column:
    return F.coalesce(F.split_part(host(url), F.lit("."), F.lit(1)), F.lit(""))


def names_entity(name: Column, website: Column, text: Column) -> Column:
    """Whether a text names an entity: its name (one of up to three letters as a word), or the first label of its site if over four letters."""
    low, n, root = F.lower(clean(text)), F.lower(name), root_label(website)
    short = F.contains(low, F.concat(n, F.lit(" "))) | F.contains(low, F.concat(F.lit(" "), n)) | F.contains(low, F.concat(n, F.lit(".")))
    return F.when(F.length(n) <= 3, short).otherwise(F.contains(low, n) | ((F.length(root) > 4) & F.contains(low, root)))


def names_member(member: Column, text: Column) -> Column:
    """Whether a text has the full name, of two words at least, of a member."""
    name = F.lower(F.trim(member))
    return F.coalesce(name.rlike(r"\S\s+\S") & F.contains(F.lower(clean(text)), name), F.lit(False))


def on_own_site(website: Column, url: Column) -> Column:
    return F.coalesce((host(url) == host(website)) | F.endswith(host(url), F.concat(F.lit("."), host(website))), F.lit(False))


def site_named(website: Column, text: Column) -> Column:
    low, root = F.lower(clean(text)), root_label(website)
    return F.coalesce(F.contains(low, host(website)) | ((F.length(root) > 4) & F.contains(low, root)), F.lit(False))


def strong_match(name: Column, website: Column, member: Column, text: Column, url: Column) -> Column:
    """Whether a public text is about an entity: it names it or its member, and stands on or names its site, or speaks of start-ups."""
    named, told = names_entity(name, website, text), names_member(member, text)
    return (named | told) & (on_own_site(website, url) | site_named(website, text) | text.rlike(CONTEXT))


def blocked(text: Column) -> Column:
    return text.rlike(BLOCKED)


def third_party(website: Column, url: Column) -> Column:
    """Whether an address is neither the entity's nor the programme's."""
    h = host(url)
    return F.coalesce(~F.coalesce(h == host(website), F.lit(False)) & ~h.rlike(PROGRAMME), F.lit(False))


def is_post(platform: Column, url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    found = F.when(platform == "x", path.rlike(r"(?i)/status/\d+")).when(platform == "instagram", path.rlike("(?i)^/(p|reel|tv)/[^/]+")).when(platform == "linkedin", path.rlike("(?i)/feed/update/urn:li:activity:|/posts/"))
    return F.coalesce(found, F.lit(False))


def fits_platform(platform: Column, url: Column) -> Column:
    """Whether an address is on the platform's site; platforms without a rule take any address that can be parsed."""
    h = host(url)
    rule = F.when(platform == "x", h.isin("x.com", "twitter.com")).when(platform == "linkedin", h.rlike(r"(^|\.)linkedin\.com$")).when(platform == "instagram", h.rlike(r"(^|\.)instagram\.com$")).otherwise(True)
    return F.coalesce(h.isNotNull() & rule, F.lit(False))


def repository_fits(owner: Column, website: Column, slug: Column) -> Column:
    """Whether the owner of a repository has the site's first label or the slug in it, or the other way round."""
    o, root, s = F.lower(owner), root_label(website), F.regexp_replace(F.lower(slug), "[^a-z0-9]", "")
    plain = F.regexp_replace(o, "[^a-z0-9]", "")
    either = lambda a, b: (F.length(a) > 2) & (F.length(b) > 2) & (F.contains(a, b) | F.contains(b, a))
    return either(plain, root) | either(plain, s)


def useful_reviews(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Review rows (entity_id, platform, url) on a platform's own site that no verified account (entity_id, platform) settles."""
    open_ = rows.filter(fits_platform(F.col("platform"), F.col("url")))
    return open_.join(verified.select("entity_id", "platform").distinct(), ["entity_id", "platform"], "left_anti")


def launch_verified(rows: DataFrame, least_words: int = 3) -> DataFrame:
    """`rows` (name, slug, website, member, title, text, words: descriptive words) with verified_by: the first of domain, slug, member and words that holds where the title has the name; null else."""
    low = F.lower(F.concat_ws(" ", "title", "text"))
    titled = F.contains(F.lower("title"), F.lower("name"))
    words = F.size(F.filter("words", lambda w: (F.length(w) > 3) & F.contains(low, F.lower(w))))
    by = F.when(site_named(F.col("website"), low), "domain").when(F.contains(low, F.lower("slug")), "slug").when(names_member(F.col("member"), low), "member").when(words >= least_words, "words")
    return rows.withColumn("verified_by", F.when(titled, by))


def launch_candidate(name: Column, slug: Column, title: Column, url: Column) -> Column:
    """Whether a link may be an entity's launch: name or slug in it, or two of the slug's words (one if it has one)."""
    low = F.lower(F.concat_ws(" ", title, url))
    parts = F.filter(F.split(F.lower(slug), "-"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(parts, lambda w: F.contains(low, w)))
    return F.contains(low, F.lower(name)) | F.contains(low, F.lower(slug)) | ((F.size(parts) > 0) & (hits >= F.least(F.lit(2), F.size(parts))))


def targets(links: DataFrame, overrides: DataFrame) -> DataFrame:
    """platform, entity_id, url: accounts to visit, overrides in place of links of the same platform, entity and address; the last one wins."""
    key = F.regexp_replace(F.lower(F.regexp_replace("url", r"^https?://(www\.)?", "")), r"[/?#]*$", "")
    both = links.withColumn("_from", F.lit(0)).unionByName(overrides.withColumn("_from", F.lit(1))).withColumn("_key", key)
    return both.groupBy("platform", "entity_id", "_key").agg(F.max_by("url", F.struct("_from", "ordinal", "url")).alias("url")).drop("_key")


def covered_targets(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """`rows` (entity_id, owner, repo (null for the owner as a whole), source): of equal targets the best source, and no repository whose owner is a target."""
    rank = F.coalesce(reduce(lambda out, k: out.when(F.col("source") == k[0], k[1]), list(ranks.items())[1:], F.when(F.col("source") == list(ranks)[0], list(ranks.values())[0])), F.lit(99))
    first = F.row_number().over(Window.partitionBy("entity_id", F.lower("owner"), F.lower(F.coalesce("repo", F.lit("")))).orderBy(rank, "source", "owner", "repo"))
    kept = rows.withColumn("_k", first).filter("_k = 1").drop("_k").withColumn("_owner", F.lower("owner"))
    whole = kept.filter("repo IS NULL").select("entity_id", "_owner").distinct().withColumn("_whole", F.lit(True))
    return kept.join(whole, ["entity_id", "_owner"], "left").filter("repo IS NULL OR _whole IS NULL").drop("_owner", "_whole")


def first_choice(rows: DataFrame, key: str) -> DataFrame:
    """key and url: the first verified candidate, else one to review, else any not rejected."""
    rank = F.when(F.col("state") == "verified", 0).when(F.col("state") == "needs_review", 1).otherwise(2)
    return rows.filter("state <> 'rejected'").groupBy(key).agg(F.min_by("url", F.struct(rank.alias("r"), "ordinal")).alias("url"))


def patched(rows: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`rows` with fields that `found` has otherwise, and `changed`, how many of them."""
    new = found.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = rows.join(new, key, "left")
    differs = {c: F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields}
    changed = sum((d.cast("int") for d in differs.values()), F.lit(0))
    return out.select(*[F.when(differs[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns], changed.alias("changed"))


def attempt_status(n_found: Column, n_review: Column, n_failed: Column, disabled: Column) -> Column:
    """Of what a connector brought back: found, needs_review, failed, skipped or no_results."""
    return F.when(disabled, "skipped").when(n_found > 0, "found").when(n_review > 0, "needs_review").when(n_failed > 0, "failed").otherwise("no_results")


def target_coverage(rows: DataFrame) -> DataFrame:
    """One row: n_targets, n_attempted, n_empty, n_failed and n_entities of target rows (entity_id, attempted, found, failed)."""
    return rows.agg(
        F.count("*").alias("n_targets"), F.count_if("attempted").alias("n_attempted"), F.count_if(F.col("attempted") & (F.col("found") == 0) & ~F.col("failed")).alias("n_empty"), F.count_if("failed").alias("n_failed"),
        F.countDistinct(F.when(F.col("found") > 0, F.col("entity_id"))).alias("n_entities"),
    )


def limit_between(value: Column, fallback: int = 10, most: int = 50) -> Column:
    return F.least(F.greatest(F.floor(F.coalesce(value, F.lit(fallback))), F.lit(1)), F.lit(most)).cast("int")
