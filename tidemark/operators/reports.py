"""Coverage, task grids, facets, anomalies, attempt patterns: reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import normal_query


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Each value with its count, 0 included."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return known.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def coverage(evidence: DataFrame, platforms: list[str]) -> DataFrame:
    """platform, rows, scored rows and entities with a score, of each platform."""
    agg = evidence.groupBy("platform").agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") > 0).alias("n_scored"), F.countDistinct(F.when(F.col("score") > 0, F.col("entity_id"))).alias("n_entities"))
    known = evidence.sparkSession.createDataFrame([(p,) for p in platforms], "platform string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(agg, "platform", "left").select("platform", zero("n_rows"), zero("n_scored"), zero("n_entities"))


def coverage_with_reviews(evidence: DataFrame, review: DataFrame, platforms: list[str]) -> DataFrame:
    """`coverage` with entities that have any row, and rows to review (platform)."""
    any_row = evidence.groupBy("platform").agg(F.countDistinct("entity_id").alias("n_with_rows"))
    open_ = review.groupBy("platform").agg(F.count("*").alias("n_review"))
    out = coverage(evidence, platforms).join(any_row, "platform", "left").join(open_, "platform", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_with_rows", "n_review")})


def entity_coverage(entities: DataFrame, evidence: DataFrame, weighted: list[str], code: str = "github") -> DataFrame:
    """entity_id with counts of rows, of scored ones and of those not from where code lies, its platforms, those with a score, and the weighted ones without."""
    scored = F.col("score") > 0
    agg = evidence.groupBy("entity_id").agg(
        F.count("*").alias("n_rows"), F.count_if(scored).alias("n_scored"), F.count_if(scored & (F.col("platform") != code)).alias("n_scored_elsewhere"), F.sort_array(F.collect_set("platform")).alias("platforms"),
        F.sort_array(F.collect_set(F.when(scored, F.col("platform")))).alias("scored_platforms"),
    )
    empty = F.array().cast("array<string>")
    out = entities.select("entity_id").join(agg, "entity_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_scored", "n_scored_elsewhere")} | {c: F.coalesce(c, empty) for c in ("platforms", "scored_platforms")})
    return out.withColumn("lacking", F.array_except(F.array(*map(F.lit, weighted)), "scored_platforms"))


def task_grid(entities: DataFrame, platforms: list[str], scored: DataFrame, review: DataFrame, disabled: list[str], slow: list[str]) -> DataFrame:
    """entity_id, platform and status of every entity on every platform. The platforms are a short list, so each entity explodes into its rows."""
    grid = entities.select("entity_id", F.explode(F.array(*map(F.lit, platforms))).alias("platform"))
    mark = lambda df, name: df.select("entity_id", "platform").distinct().withColumn(name, F.lit(True))
    rows = grid.join(mark(scored, "done"), ["entity_id", "platform"], "left").join(mark(review, "open"), ["entity_id", "platform"], "left")
    status = F.when(F.col("done"), "completed").when(F.col("open"), "needs_review").when(F.col("platform").isin(*disabled), "skipped").when(F.col("platform").isin(*slow), "blocked_or_empty").otherwise("queued")
    return rows.select("entity_id", "platform", status.alias("status"))


def missing(entities: DataFrame, platforms: list[str], scored: DataFrame) -> DataFrame:
    """entity_id with the platforms it has and those it lacks, as sorted arrays."""
    have = scored.groupBy("entity_id").agg(F.sort_array(F.collect_set("platform")).alias("have"))
    rows = entities.select("entity_id").join(have, "entity_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return rows.withColumn("lacking", F.array_except(F.sort_array(F.array(*map(F.lit, platforms))), "have"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(column).alias("facet"), "value", "n")


def attempt_patterns(attempts: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent patterns of (platform, status, query) with counts, results and up to five addresses, placeholders for names and URLs."""
    rows = attempts.select("platform", "status", normal_query(F.col("query")).alias("pattern"), "results", *[c for c in ("url",) if c in attempts.columns])
    urls = [F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 5), " ").alias("examples")] if "url" in attempts.columns else []
    agg = rows.groupBy("platform", "status", "pattern").agg(F.count("*").alias("n"), F.sum("results").alias("results"), *urls)
    return agg.orderBy(F.desc("n"), "platform", "status", "pattern").limit(limit)


def discovery_paths(paths: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent ways of discovery: host, platform, state, reason and their counts."""
    agg = paths.groupBy("host", "platform", "state", "reason").agg(F.count("*").alias("n"))
    return agg.orderBy(F.desc("n"), "host", "platform", "state", "reason").limit(limit)


#: What text suggests that an entity posts pictures.
LIKELY_PICTURES = "consumer|creator|video|design|game|social|media|assistant"


def anomaly_rules() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Kind of anomaly: when it holds, and who follows it up. Fixed thresholds.

    Over views, stars, n_social, n_scored, score, text, n_instagram,
    has_x_account, n_x and n_foreign (rows attached to another entity).
    """
    f = F.col
    return {
        "high_raw_views_low_score": ((f("views") >= 50_000) & (f("score") < 40), ("scoring_worker", "metric_worker")),
        "high_github_low_score": ((f("stars") >= 1_000) & (f("score") < 45), ("scoring_worker", "discovery_worker")),
        "high_social_low_score": ((f("n_social") >= 3) & (f("score") < 45), ("scoring_worker",)),
        "many_posts_low_score": ((f("n_scored") >= 10) & (f("score") < 35), ("dedupe_worker", "scoring_worker")),
        "no_scored_evidence": (f("n_scored") == 0, ("discovery_worker", "website_worker")),
        "missing_likely_instagram": ((f("n_instagram") == 0) & F.lower("text").rlike(LIKELY_PICTURES), ("instagram_worker", "discovery_worker")),
        "missing_x_posts": (f("has_x_account") & (f("n_x") == 0), ("profile_worker", "platform_post_worker")),
        "cross_company_attribution": (f("n_foreign") > 0, ("dedupe_worker", "profile_worker")),
    }


def anomalies(features: DataFrame, key: str, ordinal: str, most: dict[str, int] | None = None) -> DataFrame:
    """key, kind, n (rows that the kind stands for) and workers of each rule that holds, in one pass; `most` bounds a kind to its first entities by `ordinal`."""
    rules = anomaly_rules()
    many = {"cross_company_attribution": F.col("n_foreign")}
    made = [
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), many.get(kind, F.lit(1)).cast("long").alias("n"), F.array(*map(F.lit, workers)).alias("workers")))
        for kind, (when, workers) in rules.items()
    ]
    rows = features.select(key, F.col(ordinal).alias("_ordinal"), F.explode(F.filter(F.array(*made), lambda h: h.isNotNull())).alias("h")).select(key, "_ordinal", "h.*")
    for kind, k in ({"missing_likely_instagram": 50} if most is None else most).items():
        first = rows.filter(F.col("kind") == kind).orderBy("_ordinal", key).limit(k)
        rows = rows.filter(F.col("kind") != kind).unionByName(first)
    return rows.drop("_ordinal")


def follow_ups(found: DataFrame, names: DataFrame, key: str, name: str, batch: str) -> DataFrame:
    """A task for each worker of each anomaly: key, kind, worker, priority and query_seed."""
    rows = found.join(names.select(key, name), key).select(key, "kind", name, F.explode("workers").alias("worker"), "n")
    priority = F.when(F.contains("kind", F.lit("instagram")), "high").otherwise("normal")
    return rows.select(key, "kind", "worker", "n", priority.alias("priority"), F.concat_ws(" ", name, F.lit(batch)).alias("query_seed"))


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A report's table as Markdown: its first `most` rows, which is what the driver gets."""
    line = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "/") for v in values) + " |"
    return "\n".join([f"## {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *(line(r) for r in rows.limit(most).collect()), ""])
