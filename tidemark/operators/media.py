"""Pictures of posts: candidates out of captured texts, which of them to show, and how well accounts of pictures are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What an address of a picture looks like, and what is never one of a post.
PICTURE = r"(?i)\.(?:jpg|jpeg|png|webp|gif)(?:[?#]|$)|[?&]format=(?:jpg|jpeg|png|webp|gif)\b|i\.ytimg\.com/vi/|pbs\.twimg\.com/(?:media|amplify_video_thumb|tweet_video_thumb|card_img)/|media\.licdn\.com|cdninstagram\.com|ph-files\.imgix\.net"
REJECTED = r"(?i)profile_images|profile-displayphoto|favicon|avatar|emoji|sprite|logo"
#: Hosts that a platform's own pictures come from.
OWN_HOSTS = {"x": r"pbs\.twimg\.com", "instagram": r"cdninstagram\.com|fbcdn\.net", "linkedin": r"media\.licdn\.com", "youtube": r"ytimg\.com", "product_hunt": r"imgix\.net", "github": r"githubassets\.com|opengraph"}


def cleaned(url: Column) -> Column:
    """An http address without escapes and signs that follow it in a text; null if it is none."""
    t = F.replace(F.replace(F.replace(F.trim(url), F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, r"[)\].,;]+$", "")
    return F.when(F.try_parse_url(t, F.lit("PROTOCOL")).isin("http", "https"), t)


def candidates(urls: Column, raw: Column) -> Column:
    """Array of distinct clean addresses: those given, then pictures of Markdown, values under keys that name pictures, and bare addresses in a captured text."""
    text = F.coalesce(raw, F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (
        r"!\[[^\]]*\]\((https?://[^)\s]+)\)", r'(?i)"[^"]*(?:thumbnail|poster|image|media|cover)[^"]*"\s*:\s*\[?\s*"(https?:[^"]+)"', r'(https?:(?:\\?/){2}[^\s"<>)]+\.(?:jpg|jpeg|png|webp|gif)[^\s"<>)]*)',
    )]
    every = F.concat(F.coalesce(urls, F.array().cast("array<string>")), *found)
    return F.array_distinct(F.filter(F.transform(every, cleaned), lambda x: x.isNotNull()))


def choose(platform: Column, addresses: Column) -> Column:
    """The first picture from the platform's own hosts, else the first that is no avatar or logo; null where there is none."""
    good = F.filter(addresses, lambda x: x.rlike(PICTURE) & ~x.rlike(REJECTED))
    own = F.lit("$^")
    for name, pattern in OWN_HOSTS.items():
        own = F.when(platform == name, pattern).otherwise(own)
    return F.coalesce(F.get(F.filter(good, lambda x: F.rlike(x, own)), F.lit(0)), F.get(good, F.lit(0)))


def video_picture(url: Column) -> Column:
    """The still of a video by its address; null where the address has no id."""
    v = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.nullif(F.regexp_extract(url, r"(?:youtu\.be/|/shorts/)([A-Za-z0-9_-]+)", 1), F.lit("")))
    return F.concat(F.lit("https://i.ytimg.com/vi/"), v, F.lit("/hqdefault.jpg"))


def resolve(platform: Column, stored: Column, urls: Column, raw: Column, source_url: Column) -> Column:
    """Struct of picture and origin: the stored one, a video's still, or the one chosen out of the candidates."""
    pick = lambda url, origin: F.struct(url.alias("picture"), origin.alias("origin"))
    chosen = choose(platform, candidates(urls, raw))
    still = F.when(platform == "youtube", video_picture(source_url))
    none = F.lit(None).cast("string")
    return F.when(cleaned(stored).isNotNull(), pick(cleaned(stored), F.lit("stored"))).when(still.isNotNull(), pick(still, F.lit("video"))).otherwise(pick(chosen, F.when(chosen.isNotNull(), "media").otherwise(none)))


def account_coverage(entities: DataFrame, evidence: DataFrame, verified: DataFrame, attempts: DataFrame) -> DataFrame:
    """entity_id, n_rows, n_scored, n_pictures, top_url of the best row, and reason: why an entity has no scored row, null if it has.

    evidence: entity_id, score, url, picture. verified: entity_id of known
    accounts. attempts: entity_id, status (needs_review, failed, no_results).
    """
    rows = evidence.groupBy("entity_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("score") > 0).alias("n_scored"), F.count_if(F.coalesce("picture", F.lit("")) != "").alias("n_pictures"), F.max_by("url", F.struct("score", "url")).alias("top_url"),
    )
    tried = attempts.groupBy("entity_id").agg(*[F.bool_or(F.col("status") == s).alias(s) for s in ("needs_review", "failed", "no_results")])
    out = entities.select("entity_id").join(rows, "entity_id", "left").join(verified.select("entity_id").distinct().withColumn("known", F.lit(True)), "entity_id", "left").join(tried, "entity_id", "left")
    reason = F.when(F.col("known"), "no_scored_post").when(F.col("needs_review"), "candidate_in_review").when(F.col("failed"), "discovery_failed").when(F.col("no_results"), "nothing_found").otherwise("no_target")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("entity_id", zero("n_rows"), zero("n_scored"), zero("n_pictures"), "top_url", F.when(F.coalesce("n_scored", F.lit(0)) == 0, reason).alias("reason"))


#: Pictures that stand in for one.
STAND_IN = r"(?i)\.svg$|fallback|placeholder"


def profile_counters(companies: DataFrame, founders: DataFrame, candidates: DataFrame, attempts: DataFrame, platform: str) -> DataFrame:
    """One row with the eleven counts of profiles of a platform.

    companies and founders: links and overrides, maps from platform to URL.
    candidates: review_state. attempts: status.
    """
    has = lambda c: F.count_if(F.coalesce(F.try_element_at(c, F.lit(platform)), F.lit("")) != "")
    state = lambda c, value, out: F.count_if(F.col(c) == value).alias(out)
    parts = [
        companies.agg(has("links").alias("company_profiles"), has("overrides").alias("company_overrides")), founders.agg(has("links").alias("founder_profiles"), has("overrides").alias("founder_overrides")),
        candidates.agg(F.count("*").alias("candidates"), *[state("review_state", s, f"candidates_{s}") for s in ("needs_review", "rejected", "failed")]),
        attempts.agg(F.count("*").alias("attempts"), *[state("status", s, f"attempts_{s}") for s in ("no_results", "failed")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def evidence_counters(evidence: DataFrame) -> DataFrame:
    """By platform: rows, scored rows, entities with rows and with scored rows, rows with a picture and with a real one. evidence: platform, entity_id, score, picture."""
    scored, picture = F.col("score") > 0, F.coalesce("picture", F.lit("")) != ""
    real = picture & ~F.coalesce("picture", F.lit("")).rlike(STAND_IN)
    return evidence.groupBy("platform").agg(
        F.count("*").alias("n_rows"), F.count_if(scored).alias("n_scored"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct(F.when(scored, F.col("entity_id"))).alias("n_scored_entities"),
        F.count_if(picture).alias("n_pictures"), F.count_if(real).alias("n_real_pictures"),
    )


def picture_origins(evidence: DataFrame) -> DataFrame:
    """platform, origin (none where there is none) and the number of rows: where pictures come from."""
    return evidence.groupBy("platform", F.coalesce("origin", F.lit("none")).alias("origin")).agg(F.count("*").alias("n"))
