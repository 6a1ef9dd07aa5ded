"""Traction scores: evidence, platforms within an entity, entities, and calibration within a batch.

Per-platform extremes are one aggregate joined back, not a window: there are
few platforms, and a window over one would hold a large share of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import decay
from tidemark.functions.num import clamp, jround, safe
from tidemark.operators.config import DEMO_METRICS, LIBRARY_PLATFORMS, LIVE, Scoring, lookup
from tidemark.operators.ordering import running
from tidemark.session import durable


def weighted_sum(metrics: Column, weights: dict[str, float]) -> Column:
    """Sum of a metric map's values by weight; unknown metrics weigh nothing."""
    return _summed(metrics, _literal(weights))


def _literal(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")


def _summed(metrics: Column, weights: Column) -> Column:
    """Over the metrics that a row has, so the tree stays as small as one term."""
    term = lambda e: safe(e["value"]) * F.coalesce(weights[e["key"]], F.lit(0.0))
    return F.aggregate(F.map_entries(metrics), F.lit(0.0), lambda n, e: n + term(e))


def raw_engagement(platform: Column, metrics: Column, config: Scoring = LIVE) -> Column:
    """By the platform's weights, or by the fallback platform's where that gives nothing."""
    tables = F.create_map(*[x for name, weights in config.metric_weights.items() for x in (F.lit(name), _literal(weights))])
    empty = F.create_map().cast("map<string,double>")
    fallback = config.metric_weights[config.fallback_platform]
    # Both sums stand in one struct, which is computed once.
    sums = F.struct(_summed(metrics, F.coalesce(tables[platform], empty)).alias("own"), _summed(metrics, _literal(fallback)).alias("other"))
    return F.element_at(F.transform(F.array(sums), lambda x: F.when(x["own"] > 0, x["own"]).otherwise(x["other"])), 1)


def evidence_scores(evidence: DataFrame, as_of: Column, config: Scoring = LIVE) -> DataFrame:
    """`evidence` (platform, raw, posted_at, eligible) with recency, logged and score.

    Within a platform, log(1 + raw * recency) of eligible rows above 0 is scaled
    to 5..100; 50 where all are equal, 0 for rows that are not eligible.
    """
    recency = decay(F.col("posted_at"), as_of, config.half_life(F.col("platform")))
    eligible = F.col("eligible") & ~F.col("platform").isin(*config.unscored)
    # An array of one is exploded, so that what follows on either side of the join reads values and not expressions.
    made = F.struct(F.col("raw").alias("raw"), recency.alias("recency"), F.log1p(F.col("raw") * recency).alias("logged"))
    rows = evidence.select(*[c for c in evidence.columns if c != "raw"], F.inline(F.array(made)))
    counts = eligible & (F.col("raw") * F.col("recency") > 0)
    ends = rows.groupBy("platform").agg(F.min(F.when(counts, F.col("logged"))).alias("low"), F.max(F.when(counts, F.col("logged"))).alias("high"))
    scaled = jround(5 + 95 * (F.col("logged") - F.col("low")) / (F.col("high") - F.col("low")))
    score = F.when(~counts, 0.0).when(F.col("high") == F.col("low"), 50.0).otherwise(scaled)
    return rows.join(F.broadcast(ends), "platform", "left").withColumn("score", F.coalesce(score, F.lit(0.0))).drop("low", "high")


def platform_scores(scored: DataFrame, config: Scoring = LIVE, *, view_heavy: bool = True) -> DataFrame:
    """entity_id, platform, n and platform_score of positive scores in `scored` (entity_id, platform, score, ordinal)."""
    order = Window.partitionBy("entity_id", "platform").orderBy(F.desc("score"), "ordinal")
    rows = scored.filter("score > 0").withColumn("place", F.row_number().over(order))
    top = lambda k: F.avg(F.when(F.col("place") <= k, F.col("score")))
    agg = rows.groupBy("entity_id", "platform").agg(F.count("*").alias("n"), F.max("score").alias("best"), top(3).alias("top3"), top(5).alias("top5"), F.avg("score").alias("all"))
    n = F.col("n")
    depth5 = F.least(F.lit(100.0), n / 5 * 100)
    code = 0.78 * F.col("best") + 0.17 * F.col("top3") + 0.05 * F.least(F.lit(100.0), F.log1p(n) / F.log1p(F.lit(20)) * 100)
    views = 0.6 * F.col("best") + 0.35 * F.col("top3") + 0.05 * depth5
    other = 0.7 * F.col("top5") + 0.2 * F.col("all") + 0.1 * depth5
    score = F.when(F.col("platform") == "github", code)
    if view_heavy:
        score = score.when(F.col("platform").isin(*config.view_heavy), views)
    return agg.select("entity_id", "platform", n, jround(score.otherwise(other)).alias("platform_score"))


def mean_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and mean of its values, added up one by one in a unique order, so that reruns and splits of a table give the same double. Nulls count as missing."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.filter(F.col(value).isNotNull()).select(key, order, F.sum(value).over(upto).alias("_sum"))
    return sums.groupBy(key).agg((F.max_by("_sum", order) / F.count("*")).alias("mean"))


def entity_scores(by_platform: DataFrame, config: Scoring = LIVE) -> DataFrame:
    """entity_id, n_platforms, n_evidence and total: the weighted mean over what is there by 0.85 + 0.15 * sqrt(share of platforms).

    Weights count in whole millionths, and platform scores are whole, so the
    sums are exact and the order of rows decides no tie.
    """
    rows = by_platform.withColumn("weight", config.weight(F.col("platform"))).filter("weight IS NOT NULL")
    parts = F.round(F.col("weight") * 1e6)
    agg = rows.groupBy("entity_id").agg(F.count("*").alias("n_platforms"), F.sum("n").alias("n_evidence"), (F.sum(F.col("platform_score") * parts) / F.sum(parts)).alias("mean"))
    cover = 0.85 + 0.15 * F.sqrt(F.col("n_platforms") / len(config.platform_weights))
    return agg.select("entity_id", "n_platforms", "n_evidence", jround(F.col("mean") * cover).alias("total"))


def weight_shares(by_platform: DataFrame, config: Scoring = LIVE) -> DataFrame:
    """`by_platform` with the platform's share of the weights an entity has."""
    rows = by_platform.withColumn("weight", config.weight(F.col("platform"))).filter("weight IS NOT NULL")
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("entity_id")))


def calibrate(entities: DataFrame, power: float = 1.18) -> DataFrame:
    """`entities` (total, n_evidence) with factor and final: spread over the batch, held down where evidence is thin.

    Where no total is above 0, or all are equal, totals stay.
    """
    depth = F.least(F.lit(1.0), F.sqrt(F.col("n_evidence") / 5))
    rows = entities.withColumn("factor", F.when(F.col("n_evidence") > 0, 0.72 + 0.28 * depth).otherwise(0.0))
    rows = rows.withColumn("held", F.col("total") * F.col("factor"))
    ends = rows.agg(F.min(F.when(F.col("held") > 0, F.col("held"))).alias("low"), F.max(F.when(F.col("held") > 0, F.col("held"))).alias("high"))
    place = clamp((F.col("held") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), 0.0, 1.0)
    spread = jround(F.pow(place, F.lit(power)) * 100)
    final = F.when(F.col("low").isNull() | (F.col("low") == F.col("high")), F.col("total")).when(F.col("held") <= 0, 0.0).otherwise(jround(spread * F.col("factor")))
    return rows.crossJoin(F.broadcast(ends)).withColumn("final", final).drop("held", "low", "high")


# The library model: percentiles in place of extremes, verified accounts only.


@dataclass(frozen=True)
class Library:
    half_life_days: float = 30.0
    top: int = 5


def midranks(rows: DataFrame, keys: list[str], measures: dict[str, str], population: DataFrame | None = None) -> DataFrame:
    """`rows` with a column for each of `measures` (value to name): the share of the population's values within its keys that are smaller, those equal by half.

    population has the keys and values, and is `rows` itself if not given. A
    value that it lacks ranks by the smaller ones. Null ranks 0.5, as does any
    value where the population has none; what is not finite ranks 0 and counts
    for nothing. All measures are summed in one pass by ranges.
    """
    finite = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(F.col(v)) != F.lit(float("inf")))
    rows = durable(rows.withColumns({v: F.col(v).cast("double") for v in measures}), "probes")

    def melted(df: DataFrame, n: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(v).alias("_kind"), F.when(finite(v), F.col(v)).alias("_value")) for v in measures])
        return df.select(*keys, F.inline(each)).filter("_value IS NOT NULL").groupBy(*keys, "_kind", "_value").agg((F.count("*") * n).alias("_n"))

    if population is None:
        counts = melted(rows, 1)
    else:
        both = melted(population.withColumns({v: F.col(v).cast("double") for v in measures}), 1).unionByName(melted(rows, 0))
        counts = both.groupBy(*keys, "_kind", "_value").agg(F.sum("_n").alias("_n"))
    held = running(counts, [*keys, "_kind"], "_value", "_n", "_upto", "_whole")
    ranks = durable(held.select(*keys, "_kind", "_value", F.when(F.col("_whole") > 0, (F.col("_upto") - F.col("_n") / 2) / F.col("_whole")).alias("_rank")), "ranks")
    for v, out in measures.items():
        of = ranks.filter(F.col("_kind") == v).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_value", "_rank")
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(v) == F.col("_value")]
        rank = F.when(F.col(v).isNotNull() & ~finite(v), 0.0).otherwise(F.coalesce("_rank", F.lit(0.5)))
        rows = rows.join(of, on, "left").withColumn(out, rank).drop("_value", "_rank", *[f"_k{i}" for i in range(len(keys))])
    return rows


def midrank(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """`rows` with the mid-rank of one value among themselves."""
    return midranks(rows, keys, {value: out})


def post_scores(posts: DataFrame, config: Library = Library()) -> DataFrame:
    """`posts` (platform, raw, age_days, followers) with post_score 0..100 from three percentiles within the platform.

    Engagement counts 0.5, engagement by follower 0.3, decayed engagement 0.2;
    an unknown age decays to 0.75, unknown followers rank in the middle.
    """
    recency = F.when(F.col("age_days").isNull(), 0.75).when(F.isnan("age_days") | (F.col("age_days") < 0), 1.0).otherwise(F.pow(F.lit(0.5), F.col("age_days") / max(config.half_life_days, 1.0)))
    rows = posts.withColumn("_log", F.log1p("raw")).withColumn("recency", recency)
    rows = rows.withColumn("_rate", F.col("raw") / F.greatest(F.abs("followers"), F.lit(1.0))).withColumn("_momentum", F.col("_log") * F.col("recency"))
    rows = midranks(rows, ["platform"], {"_log": "p_log", "_rate": "p_rate", "_momentum": "p_momentum"})
    score = 100 * (0.5 * F.col("p_log") + 0.3 * F.col("p_rate") + 0.2 * F.col("p_momentum"))
    return rows.withColumn("post_score", jround(clamp(score, 0.0, 100.0), 2)).drop("_log", "_rate", "_momentum")


def account_scores(posts: DataFrame, config: Library = Library()) -> DataFrame:
    """entity_id, platform and score: 0.75 top posts, 0.15 consistency, 0.10 account percentile; 0 unless verified.

    posts: entity_id, platform, post_score, ordinal, review_state, follower_percentile.
    """
    order = Window.partitionBy("entity_id", "platform").orderBy(F.desc("post_score"), "ordinal")
    rows = posts.withColumn("place", F.row_number().over(order))
    agg = rows.groupBy("entity_id", "platform").agg(
        F.coalesce(F.avg(F.when(F.col("place") <= config.top, F.col("post_score"))), F.lit(0.0)).alias("top"), F.count("post_score").alias("n"),
        F.max("review_state").alias("review_state"), F.max("follower_percentile").alias("follower_percentile"),
    )
    consistency = jround(F.least("n", F.lit(config.top)) / config.top * 100, 2)
    account = F.when(F.col("follower_percentile").isNull(), 50.0).otherwise(jround(clamp(F.col("follower_percentile"), 0.0, 1.0) * 100, 2))
    score = jround(clamp(0.75 * F.col("top") + 0.15 * consistency + 0.10 * account, 0.0, 100.0), 2)
    return agg.select("entity_id", "platform", "n", "review_state", F.when(F.col("review_state") == "verified", score).otherwise(0.0).alias("score"))


def composite(scores: DataFrame, platform_weights: dict[str, float], official: float = 0.6, member: float = 0.4) -> DataFrame:
    """entity_id and absolute: by platform, official and members' scores weighed 0.6 to 0.4, what is missing left out; then by platform weight.

    scores: entity_id, platform, official (boolean), score.
    """
    side = lambda flag: F.avg(F.when(F.col("official") == flag, F.col("score")))
    both = scores.groupBy("entity_id", "platform").agg(side(True).alias("o"), side(False).alias("m"))
    weight = F.when(F.col("o").isNull(), 0.0).otherwise(official) + F.when(F.col("m").isNull(), 0.0).otherwise(member)
    value = (F.coalesce(F.col("o") * official, F.lit(0.0)) + F.coalesce(F.col("m") * member, F.lit(0.0))) / weight
    rows = both.withColumn("value", value).withColumn("w", lookup(platform_weights, F.col("platform"))).filter("w IS NOT NULL")
    return rows.groupBy("entity_id").agg(jround(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 2).alias("absolute"), F.count("*").alias("n_platforms"))


def review_rollup(scores: DataFrame, key: str, state: str) -> DataFrame:
    """Any verified makes verified; all rejected, rejected; else needs_review."""
    agg = scores.groupBy(key).agg(F.bool_or(F.col(state) == "verified").alias("any"), F.bool_and(F.col(state) == "rejected").alias("all"))
    return agg.select(key, F.when(F.col("any"), "verified").when(F.col("all"), "rejected").otherwise("needs_review").alias("review_state"))


def learned_weights(evidence: DataFrame) -> DataFrame:
    """platform and weight, each platform's share of sqrt(entities + 1) * sqrt(variance of log(1 + raw) + 1)."""
    agg = evidence.groupBy("platform").agg((F.sqrt(F.countDistinct("entity_id") + 1.0) * F.sqrt(F.var_pop(F.log1p("raw")) + 1)).alias("strength"))
    total = agg.agg(F.sum("strength").alias("total"))
    return agg.crossJoin(F.broadcast(total)).select("platform", (F.col("strength") / F.col("total")).alias("weight"))


def experiment_scores(by_platform: DataFrame, platform_weights: dict[str, float]) -> DataFrame:
    """entity_id and experiment: the balanced score with other weights, calibrated 0.82 of its own and 0.18 of its spread."""
    config = Scoring(platform_weights=platform_weights)
    rows = entity_scores(by_platform, config)
    factor = 0.72 + 0.28 * F.least(F.lit(1.0), F.sqrt(F.col("n_evidence") / 5))
    rows = rows.withColumn("held", F.col("total") * factor)
    ends = rows.agg(F.min("held").alias("low"), F.max("held").alias("high"))
    spread = F.coalesce((F.col("held") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5)) * 100
    return rows.crossJoin(F.broadcast(ends)).select("entity_id", "n_platforms", jround(0.82 * F.col("held") + 0.18 * spread, 2).alias("experiment"))


def composite_total(by_platform: DataFrame, platform_weights: dict[str, float] = LIBRARY_PLATFORMS) -> DataFrame:
    """entity_id, absolute, percentile, total, coverage and review_state of platform scores (entity_id, platform, score, state).

    Verified scores above 0 of weighted platforms are averaged by weight and
    held down by 0.85 + 0.15 * sqrt(share of platforms); the total is the mid-rank
    percentile of that among the entities. coverage: the share of weight there.
    """
    rows = by_platform.withColumn("_w", lookup(platform_weights, F.col("platform"), 0.0))
    rows = rows.withColumn("_on", (F.col("_w") > 0) & (F.col("score") > 0) & (F.col("state") == "verified"))
    w = F.when(F.col("_on"), F.col("_w"))
    agg = rows.groupBy("entity_id").agg(
        F.count_if("_on").alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"), F.coalesce(F.sum(F.col("score") * w) / F.sum(w), F.lit(0.0)).alias("mean"),
        F.bool_or(F.col("state") == "verified").alias("_any"), F.bool_and(F.col("state") == "rejected").alias("_all"),
    )
    factor = F.when(F.col("n") > 0, 0.85 + 0.15 * F.sqrt(F.col("n") / len(platform_weights))).otherwise(0.0)
    agg = agg.withColumn("absolute", jround(jround(F.col("mean"), 2) * factor, 2))
    ranked = midrank(agg, [], "absolute", "percentile")
    state = F.when(F.col("_any"), "verified").when(F.col("_all"), "rejected").otherwise("needs_review")
    return ranked.select("entity_id", "absolute", "percentile", jround(F.col("percentile") * 100, 2).alias("total"), F.least(F.lit(1.0), F.col("weight") / sum(platform_weights.values())).alias("coverage"), state.alias("review_state"))


def founder_scores(by_platform: DataFrame, relevance: DataFrame, platform_weights: dict[str, float] = LIBRARY_PLATFORMS, unknown: float = 0.85) -> DataFrame:
    """`composite_total` of founders with relevance, how much of it concerns their company (entity_id, relevance), within 0 and 1, and known, whether that was given. It is recorded and does not change the total."""
    rows = composite_total(by_platform, platform_weights).join(relevance, "entity_id", "left")
    return rows.withColumn("known", F.col("relevance").isNotNull()).withColumn("relevance", F.when(F.col("known"), clamp(F.col("relevance"), 0.0, 1.0)).otherwise(unknown))


def top_platform(by_platform: DataFrame, platform_weights: dict[str, float]) -> DataFrame:
    """entity_id and platform: the one with the most weighed score, or where none has weight the highest score; of equal ones the first by ordinal."""
    rows = by_platform.withColumn("_w", F.col("score") * lookup(platform_weights, F.col("platform"), 0.0))
    best = lambda value, when=F.lit(True): F.max_by(F.when(when, F.col("platform")), F.when(when, F.struct(value, (-F.col("ordinal")).alias("o"))))
    return rows.groupBy("entity_id").agg(F.coalesce(best("_w", F.col("_w") > 0), best("score")).alias("platform"))


def weighted_average(value: Column, weight: Column, fallback: float) -> Column:
    """An aggregate: the mean by weight of finite values with a weight above 0; the fallback where there is none."""
    good = value.isNotNull() & ~F.isnan(value) & (weight > 0)
    return F.coalesce(F.sum(F.when(good, value * weight)) / F.sum(F.when(good, weight)), F.lit(fallback))


# The demonstration model: shares of values that are at most one's own, accounts that count in full or not at all.


def demo_raw(metrics: Column) -> Column:
    return weighted_sum(metrics, DEMO_METRICS)


def demo_platform_scores(posts: DataFrame, top: int = 5) -> DataFrame:
    """entity_id, platform, n, score: 0.75 of the top posts' mean, 0.15 of how many there are of five, 0.10 for a verified account, and 0 without one.

    posts: entity_id, platform, normalized, ordinal, state (of the account).
    """
    order = Window.partitionBy("entity_id", "platform").orderBy(F.desc("normalized"), "ordinal")
    rows = posts.withColumn("_k", F.row_number().over(order))
    agg = rows.groupBy("entity_id", "platform").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_k") <= top, F.col("normalized"))).alias("top"), F.max("state").alias("state"))
    full = clamp(0.75 * F.col("top") + 0.15 * clamp(F.col("n") / top * 100, 0.0, 100.0) + 0.1 * 100, 0.0, 100.0)
    return agg.select("entity_id", "platform", "n", "state", F.when(F.col("state") == "verified", full).otherwise(0.0).alias("score"))


def demo_entity_scores(by_platform: DataFrame, platform_weights: dict[str, float] = LIBRARY_PLATFORMS, other: float = 0.05) -> DataFrame:
    """entity_id, total (by weight, 0.05 for other platforms), review_state and penalty, which is recorded and not applied."""
    w = lookup(platform_weights, F.col("platform"), other)
    agg = by_platform.groupBy("entity_id").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("total"), F.count("*").alias("n"), F.bool_or(F.col("state") == "verified").alias("_any"))
    return agg.select("entity_id", clamp(F.col("total"), 0.0, 100.0).alias("total"), F.when(F.col("_any"), "verified").otherwise("needs_review").alias("review_state"), F.least(F.lit(1.0), 0.65 + 0.08 * F.col("n")).alias("penalty"))


def experiment_lists(rows: DataFrame, most: int = 25) -> DataFrame:
    """list and entity_id: what an experiment's report lists, each list its first `most` by score.

    rows: entity_id, score, n_evidence, views, stars, top_share (of the weight,
    of the first platform), n_platforms, code (score of the repositories, or null) and social (mean of social scores, or 0).
    """
    f, code = F.col, F.coalesce("code", F.lit(0.0))
    issue = ((f("score") >= 70) & (f("n_evidence") <= 1)) | ((f("views") >= 100_000) & (f("score") < 40)) | ((f("stars") >= 5_000) & (code < 65))
    lists = {
        "top": F.lit(True), "one_platform": f("top_share") >= 0.85, "cross_platform": f("n_platforms") >= 3, "sparse": (f("score") >= 50) & (f("n_evidence") <= 2), "high_code_low_social": (code >= 70) & (f("social") < 30),
        "viral_low_code": (f("social") >= 60) & (code < 30), "high_code_low_total": (f("stars") >= 1_000) & (f("score") < 45), "bottom": F.lit(True), "views_low_score": (f("views") >= 50_000) & (f("score") < 50), "formula_issues": issue,
    }
    by = {"bottom": f("score"), "views_low_score": -f("views")}
    size = {"formula_issues": 30}
    # One pass: a row goes into its lists, each task keeps the first of a list, and few rows meet to be cut again.
    each = F.array(*[F.when(when, F.struct(F.lit(n).alias("list"), by.get(n, -f("score")).cast("double").alias("o"), F.lit(size.get(n, most)).alias("size"))) for n, when in lists.items()])
    long = rows.select("entity_id", F.inline(F.filter(each, lambda x: x.isNotNull())))
    last_first = F.col("list") == "bottom"
    order = Window.partitionBy("list").orderBy("o", F.when(~last_first, F.col("entity_id")), F.when(last_first, F.col("entity_id")).desc())
    kept = long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(most, *size.values()))
    return kept.filter(F.col("place") <= F.col("size")).select("list", "entity_id")


def config_quality(lists: DataFrame, priority: Column) -> DataFrame:
    """config and value of lists (config, list): twice the cross-platform entities, less sparse ones, a fifth of unscored views and a tenth of those of one platform, and the priority of the weights."""
    n = lambda name: F.count_if(F.col("list") == name)
    return lists.groupBy("config").agg((2 * n("cross_platform") - n("sparse") - 0.2 * n("views_low_score") - 0.1 * n("one_platform")).alias("value")).withColumn("value", F.col("value") + priority)


# Seeds at ingestion.


def seed_score(raw: Column, floor: float = 0.0) -> Column:
    return clamp(jround(18 * F.log1p(raw)), floor, 100.0)


def saturation_score(raw: Column, boost: float, saturation: float) -> Column:
    return clamp(jround(100 * F.log1p(raw * boost) / F.log1p(F.lit(saturation))), 1.0, 100.0)


def repository_score(stars: Column, forks: Column, watchers: Column, issues: Column, days_since_push: Column) -> Column:
    bonus = F.when(days_since_push <= 45, 8).when(days_since_push <= 180, 3).otherwise(0)
    return F.least(F.lit(100.0), jround(14 * F.log1p(stars) + 9 * F.log1p(forks) + 3 * F.log1p(watchers) + 1.5 * F.log1p(issues) + bonus))
