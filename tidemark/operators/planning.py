"""What to look for next: discovery plans that learn from attempts, candidates of handles, owners of evidence, and links each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import compact
from tidemark.functions.urls import host, part

#: Fixed value: what entities that picture platforms are worth a first look for are about.
VISUAL = "(?i)consumer|creator|video|design|game|media|assistant"
#: Names that many have.
COMMON_NAMES = "stage bloom hub hyper result drafted pops juno memoir dispatch archer".split()
#: The least lengths at which a handle that is a site, its first label, a slug or a name says something.
FULL_HOST, FIRST_LABEL, SLUG, NAME = 6, 5, 7, 8
#: Links of social platforms that lead to no account or post.
LOW_VALUE = {"instagram": r"(?i)/(p|reel|tv)/[^/]+/(?:liked_by|comments)/?$", "x": r"(?i)/(intent|share|search)(/|$)", "linkedin": r"(?i)/shareArticle\b|/jobs\b|/learning\b"}


def learned(attempts: DataFrame) -> DataFrame:
    """platform, pattern, n, n_useful and share, the share of useful attempts (platform, pattern, useful), smoothed by one of each kind, so that a pattern tried once is not sure."""
    agg = attempts.groupBy("platform", "pattern").agg(F.count("*").alias("n"), F.count_if("useful").alias("n_useful"))
    return agg.withColumn("share", (F.col("n_useful") + 1) / (F.col("n") + 2))


def priority(platform: Column, about: Column, accounts: Column) -> Column:
    """high where a platform of pictures meets what shows well, or an account on x is known; else normal."""
    high = ((platform == "instagram") & about.rlike(VISUAL)) | ((platform == "x") & F.array_contains(accounts, "x"))
    return F.when(F.coalesce(high, F.lit(False)), "high").otherwise("normal")


def plan(entities: DataFrame, patterns: dict[str, list[str]], evidence: DataFrame, attempts: DataFrame, most: int = 8) -> DataFrame:
    """entity_id, platform, priority, n_current, reuse_key and queries of each entity and platform without scored evidence.

    entities: entity_id, name, domain, industry, model, tagline, description,
    accounts (platforms). patterns: by platform, texts with {name} and {domain}.
    evidence: entity_id, platform, contribution. attempts: platform, pattern,
    useful. Patterns that were useful more often come first, others in the
    order given and as if useful half the time; at most `most` different queries.
    The plan has a row for each task, the learned shares one for each pattern.
    """
    spark = entities.sparkSession
    given = spark.createDataFrame([(p, k, t) for p, ts in patterns.items() for k, t in enumerate(ts)], "platform string, place int, pattern string")
    shares = given.join(learned(attempts), ["platform", "pattern"], "left").select("platform", F.struct((-F.coalesce("share", F.lit(0.5))).alias("s"), "place", "pattern").alias("p"))
    ordered = shares.groupBy("platform").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["pattern"]).alias("_patterns"))  # a row for each platform
    have = evidence.groupBy("entity_id", "platform").agg(F.count("*").alias("n_current"), F.bool_or(F.col("contribution") > 0).alias("_scored"))
    tasks = entities.crossJoin(F.broadcast(ordered)).join(have, ["entity_id", "platform"], "left").filter(~F.coalesce("_scored", F.lit(False)))
    fill = lambda p: F.replace(F.replace(p, F.lit("{name}"), F.col("name")), F.lit("{domain}"), F.coalesce("domain", F.lit("")))
    about = F.concat_ws(" ", "industry", "tagline", "description")
    return tasks.select(
        "entity_id", "platform", priority(F.col("platform"), about, F.col("accounts")).alias("priority"), F.coalesce("n_current", F.lit(0)).alias("n_current"),
        F.concat_ws(":", "platform", "industry", "model").alias("reuse_key"), F.slice(F.array_distinct(F.transform("_patterns", fill)), 1, most).alias("queries"),
    )


def _forms(entities: DataFrame) -> DataFrame:
    """`entities` (entity_id, name, slug, website) with the forms that a handle may have."""
    labels = F.filter(F.split(host(F.col("website")), r"\."), lambda x: x != "")
    full = compact(F.array_join(F.slice(labels, 1, 2), ""))
    return entities.select("entity_id", compact(F.col("name")).alias("f_name"), compact(F.col("slug")).alias("f_slug"), compact(F.get(labels, F.lit(0))).alias("f_label"), full.alias("f_full"))


def handle_candidates(candidates: DataFrame, entities: DataFrame, rejected: DataFrame) -> DataFrame:
    """`candidates` (entity_id, handle, url) with exact_full_host, exact_host, exact_slug, exact_name, ambiguous, verified and review_state.

    A form of an entity counts from its least length on. It is ambiguous where
    the name is short or one that many have, or where the handle is a form of
    another entity too; an index from forms to the number of their owners, a row
    for each form, tells. verified needs the full host and no doubt. Candidates
    in `rejected` (entity_id, url) stay rejected; others need review.
    """
    forms = _forms(entities)
    each = forms.select("entity_id", F.explode(F.array_distinct(F.array("f_name", "f_slug", "f_label", "f_full"))).alias("_handle")).filter("_handle <> ''")
    owners = each.groupBy("_handle").agg(F.count("*").alias("_owners"))
    said = rejected.select("entity_id", "url").distinct().withColumn("_rejected", F.lit(True))
    rows = candidates.withColumn("_handle", compact(F.col("handle"))).join(forms, "entity_id", "left").join(owners, "_handle", "left").join(said, ["entity_id", "url"], "left")
    is_form = lambda c, least: F.coalesce((F.length(c) >= least) & (F.col(c) == F.col("_handle")), F.lit(False))
    of_other = F.coalesce("_owners", F.lit(0)) > F.array_contains(F.array("f_name", "f_slug", "f_label", "f_full"), F.col("_handle")).cast("int")
    rows = rows.withColumns({
        "exact_full_host": is_form("f_full", FULL_HOST), "exact_host": is_form("f_label", FIRST_LABEL), "exact_slug": is_form("f_slug", SLUG), "exact_name": is_form("f_name", NAME),
        "ambiguous": F.coalesce((F.length("f_name") <= 5) | F.col("f_name").isin(COMMON_NAMES) | of_other, F.lit(True)),
    })
    rows = rows.withColumn("verified", F.col("exact_full_host") & ~F.col("ambiguous"))
    state = F.when(F.col("_rejected"), "rejected").otherwise("needs_review")
    return rows.withColumn("review_state", state).drop("_handle", "_owners", "_rejected", "f_name", "f_slug", "f_label", "f_full")


def owners(nodes: DataFrame) -> DataFrame:
    """evidence_id and entity_id of nodes (entity_id, ordinal, evidence_ids): where several list it, the last. One partial aggregate; no group is held."""
    each = nodes.select("entity_id", "ordinal", F.explode("evidence_ids").alias("evidence_id"))
    return each.groupBy("evidence_id").agg(F.max_by("entity_id", F.struct("ordinal", "entity_id")).alias("entity_id"))


def owned(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """`evidence` (id) with the entity that owns it; null where none does."""
    of = owners(nodes)
    return evidence.join(of, evidence["id"] == of["evidence_id"], "left").drop("evidence_id")


def search_target(url: Column) -> Column:
    """Where a link of a search page leads: the address in its uddg parameter; with a scheme; without query and fragment."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    to = F.nullif(part(full, "QUERY"), F.lit(""))
    target = F.nullif(F.regexp_extract(to, "(?:^|&)uddg=([^&]*)", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(F.try_url_decode(target), full), r"[?#].*$", "")


def distinct_links(links: DataFrame, keys: list[str], most: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """`links` (keys, url, ordinal and others) once for each key and url: the last row, in the place of the first; of these the first `most`.

    Rows of a url fold into one before they are shuffled, and a place beyond
    `most` is dropped by each task before the others see it, so a key with very
    many links is no large group.
    """
    others = [c for c in links.columns if c not in (*keys, "url")]
    once = links.groupBy(*keys, "url").agg(F.max_by(F.struct(*others), ordinal).alias("_last"), F.min(ordinal).alias("place")).select(*keys, "url", "_last.*", "place")
    if most is None:
        return once
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).filter(F.col("_n") <= most).drop("_n")


def social_candidates(links: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """The first candidates (keys, platform, url, ordinal), each once, without empty links and those of low value."""
    poor = F.lit(False)
    for platform, pattern in LOW_VALUE.items():
        poor = poor | ((F.col("platform") == platform) & F.col("url").rlike(pattern))
    return distinct_links(links.filter((F.coalesce("url", F.lit("")) != "") & ~F.coalesce(poor, F.lit(False))), keys, most)


def launch_links(links: DataFrame, keys: list[str], skip: str = r"(?i)/reviews\b") -> DataFrame:
    """Product pages among search links (keys, url, ordinal), by where they lead, each once: the last row in the place of the first."""
    rows = links.withColumn("url", search_target(F.col("url")))
    return distinct_links(rows.filter(F.col("url").rlike(r"(?i)^https://www\.producthunt\.com/(products|posts)/") & ~F.col("url").rlike(skip)), keys)
