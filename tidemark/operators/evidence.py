"""Evidence rows out of landed records: acceptance, projection, repositories of accounts, and what stored rows are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import age_days, within_days
from tidemark.functions.num import jround
from tidemark.functions.urls import part, post_id, site_handle
from tidemark.operators.scoring import repository_score

#: Platforms whose rows without a post are profiles; platforms that never score; what a story must name.
PROFILED, UNSCORED = ("linkedin", "x", "instagram"), ("web", "rss")
BATCH_NAMED = r"(?i)\bYC\s*(P26|S26|Spring\s+2026)\b"


def profile_only(platform: Column, url: Column, post: Column) -> Column:
    """Whether a row is of a profile and not of a post; an address that cannot be parsed is."""
    path = F.lower(F.concat(F.coalesce(part(url, "PATH"), F.lit("")), F.coalesce(F.concat(F.lit("#"), part(url, "REF")), F.lit(""))))
    is_post = (
        F.when(platform == "x", path.rlike(r"/status/\d+"))
        .when(platform == "instagram", path.rlike(r"^/(p|reel|tv)/") | path.rlike(r"#post-\d+"))
        .otherwise(path.rlike("/feed/update/|/posts/|/recent-activity/all/#post-"))
    )
    named = F.coalesce(post, F.lit("")) != ""
    return platform.isin(*PROFILED) & ~named & F.when(part(url, "HOST").isNull(), True).otherwise(~is_post)


def accepted(rows: DataFrame, known_handles: DataFrame) -> DataFrame:
    """`rows` (entity_id, platform, source_url, link_status, title, text, raw) that may be evidence.

    Rows with an invalid link go; linkedin posts stay if their author is among
    known_handles (entity_id, handle); stories stay if they name the batch.
    """
    author = F.lower(F.regexp_extract(F.coalesce("source_url", F.lit("")), r"/posts/([A-Za-z0-9-]+?)_", 1))
    known = known_handles.select("entity_id", F.col("handle").alias("_author")).distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_author", author).join(known, ["entity_id", "_author"], "left")
    named = F.concat_ws(" ", "title", "text", "raw").rlike(BATCH_NAMED)
    keep = F.when(F.col("platform") == "linkedin", F.coalesce("_known", F.lit(False))).when(F.col("platform") == "hacker_news", named).otherwise(True)
    return out.filter((F.coalesce("link_status", F.lit("")) != "invalid") & keep).select(*rows.columns)


def project(rows: DataFrame) -> DataFrame:
    """Evidence of landed records: context (unscored platforms, retweets, profiles) counts 0, the post's id and date are filled in.

    rows: id, entity_type, entity_id, platform, title, text, posted_at,
    last_updated_at, contribution, source_url, post, raw, match_reason, state.
    """
    retweet = (F.col("platform") == "x") & F.coalesce(F.col("raw").rlike(r'(?i)"is_retweet"\s*:\s*true'), F.lit(False))
    profile = profile_only(F.col("platform"), F.col("source_url"), F.col("post"))
    zero = F.col("platform").isin(*UNSCORED) | retweet | profile
    why = F.when(retweet, "retweet").when(profile, "profile").otherwise(F.col("match_reason"))
    return rows.select(
        "id", "entity_type", "entity_id", "platform", F.coalesce("posted_at", "last_updated_at").alias("posted_at"), F.coalesce(F.nullif("text", F.lit("")), "title").alias("text"),
        F.when(zero, 0.0).otherwise(F.col("contribution")).alias("contribution"), F.coalesce(F.nullif("post", F.lit("")), post_id(F.col("platform"), F.col("source_url"))).alias("post"), why.alias("why"), "state",
    )


def verified_sources(rows: DataFrame, platforms: list[str]) -> DataFrame:
    """Rows of allowed platforms that are verified."""
    return rows.filter(F.col("platform").isin(*platforms) & (F.col("state") == "verified"))


def repository_evidence(accounts: DataFrame, repos: DataFrame, checked_at: Column, most: int = 20) -> DataFrame:
    """entity_id, kind (repo or profile), name, stars, forks, recent and contribution: the best `most` rows of each account.

    accounts: entity_id, login, fetched, profile_score. repos: entity_id, name,
    stars, forks, pushed_at, score. The profile scores only where there are no
    repositories; recent counts pushes within 30 days.
    """
    recent = within_days(F.col("pushed_at"), checked_at, 30).cast("int")
    ready = accounts.filter("fetched")
    each = repos.join(ready.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.lit("repo").alias("kind"), "name", "stars", "forks", recent.alias("recent"), F.col("score").alias("contribution"))
    sums = each.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("stars").alias("stars"), F.sum("forks").alias("forks"), F.sum("recent").cast("int").alias("recent"))
    profile = ready.join(sums, "entity_id", "left").select(
        "entity_id", F.lit("profile").alias("kind"), F.col("login").alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stars", "forks", "recent")], F.when(F.col("n") > 0, 0.0).otherwise(F.col("profile_score")).alias("contribution"),
    )
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("contribution"), F.when(F.col("kind") == "profile", 0).otherwise(1), "name"))
    return profile.unionByName(each).withColumn("_k", place).filter(F.col("_k") <= most).drop("_k")


def account_totals(repos: DataFrame, as_of: Column) -> DataFrame:
    """entity_id with n_repos, sums of stars and forks, the best repository score, and the mean of the five best."""
    days = age_days(F.col("pushed_at"), as_of)
    rows = repos.withColumn("repo_score", repository_score(F.col("stars"), F.col("forks"), F.col("watchers"), F.col("issues"), days))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("repo_score"), "name")))
    return rows.groupBy("entity_id").agg(
        F.count("*").alias("n_repos"), F.sum("stars").alias("stars"), F.sum("forks").alias("forks"), F.max("repo_score").alias("best"), jround(F.avg(F.when(F.col("_k") <= 5, F.col("repo_score"))), 2).alias("top5"),
    )


def still_counts(rows: DataFrame, since: Column) -> DataFrame:
    """Stored rows with some positive metric that are not older than `since`; an unknown date passes."""
    scored = F.exists(F.map_values("metrics"), lambda v: F.coalesce(v, F.lit(0.0)) > 0)
    return rows.filter(F.coalesce(scored, F.lit(False)) & F.coalesce(F.col("posted_at") >= since, F.lit(True)))


def quarantined(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """`rows` (entity_id, platform, source_url, contribution, state): picture posts whose account is not among verified (entity_id, handle) count 0 and go to review."""
    known = verified.select("entity_id", F.col("handle").alias("_handle")).distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_handle", site_handle(F.col("source_url"))).join(known, ["entity_id", "_handle"], "left")
    bad = (F.col("platform") == "instagram") & F.col("_known").isNull()
    return out.withColumns({"contribution": F.when(bad, 0.0).otherwise(F.col("contribution")), "state": F.when(bad, "needs_review").otherwise(F.col("state"))}).select(*rows.columns)
