"""Audits of scored tables: totals, findings, the choice between configurations, task logs, and metrics read from visible text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import compact_number

#: Metrics of a repository, of which the largest counts and not the sum.
LARGEST = ("stars", "forks", "watchers")


def metric_totals(evidence: DataFrame) -> DataFrame:
    """platform, metric and total of a metric map: the largest of LARGEST on github, the sum of others."""
    rows = evidence.select("platform", F.explode("metrics").alias("metric", "value")).filter("value IS NOT NULL")
    total = F.when((F.col("platform") == "github") & F.col("metric").isin(*LARGEST), F.max("value")).otherwise(F.sum(F.col("value").cast("decimal(24,4)")).cast("double"))
    return rows.groupBy("platform", "metric").agg(total.alias("total"))


@dataclass(frozen=True)
class Check:
    """One finding: rows that `when` holds for, and what number of them is one too many."""

    name: str
    when: Column
    severity: str
    most: int = 0


def findings(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """check, severity, n and failed of every check, in one pass over the rows."""
    counts = rows.agg(*[F.count_if(F.coalesce(c.when, F.lit(False))).alias(f"c{k}") for k, c in enumerate(checks)])
    each = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.col(f"c{k}").alias("n"), (F.col(f"c{k}") > c.most).alias("failed")) for k, c in enumerate(checks)])
    return counts.select(F.inline(each))


def verdict(found: DataFrame) -> DataFrame:
    """How many checks failed by severity, and whether all is well: no high finding."""
    n = lambda s: F.count_if(F.col("failed") & (F.col("severity") == s)).alias(f"n_{s}")
    return found.agg(n("high"), n("medium"), n("low")).withColumn("passed", F.col("n_high") == 0)


def choose(quality: DataFrame, default: str, tolerance: float = 0.5) -> DataFrame:
    """The configuration (config, value) of the highest value; the default where it is within the tolerance."""
    best = quality.agg(F.max("value").alias("best"), F.max(F.when(F.col("config") == default, F.col("value"))).alias("own"), F.max_by("config", F.struct("value", F.col("config"))).alias("config"))
    keep = F.col("own") >= F.col("best") - tolerance
    return best.select(F.when(keep, default).otherwise(F.col("config")).alias("config"), F.when(keep, F.col("own")).otherwise(F.col("best")).alias("value"))


def task_summary(log: DataFrame, key: str = "task_key", status: str = "status") -> DataFrame:
    """platform (what the key has before the first colon), status and count."""
    return log.groupBy(F.split_part(key, F.lit(":"), F.lit(1)).alias("platform"), status).agg(F.count("*").alias("n"))


def metric_near(text: Column, word: str) -> Column:
    """The compact number before a word, first on the lines that have the word; null where there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lit(word)))
    found = F.regexp_extract(F.get(lines, F.lit(0)), rf"(?i)([0-9][0-9.,]*[ ]?[KMB]?)[ ]+{word}", 1)
    return compact_number(F.nullif(F.trim(found), F.lit("")))


def largest_metric(*texts: Column) -> Column:
    """The largest of several compact numbers; null where none is one."""
    return F.greatest(*map(compact_number, texts))


def search_queries(entities: DataFrame, name: Column, domain: Column, patterns: list[str], most: int = 8) -> DataFrame:
    """`entities` with a row for each distinct query of the patterns ({name}, {domain})."""
    fill = lambda p: F.replace(F.replace(F.lit(p), F.lit("{name}"), name), F.lit("{domain}"), F.coalesce(domain, F.lit("")))
    made = F.slice(F.array_distinct(F.filter(F.array(*map(fill, patterns)), lambda q: F.length(F.trim(q)) > 0)), 1, most)
    return entities.select("*", F.explode(made).alias("query"))


def trim_detail(rows: DataFrame, key: str, detail: list[str], top_key: Column, most: int, *order: Column | str) -> DataFrame:
    """Rows with detail columns for one key only, and at most so many of that key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    mine = F.col(key) == top_key
    out = rows.withColumn("_place", place).filter(~mine | (F.col("_place") <= most)).drop("_place")
    return out.withColumns({c: F.when(mine, F.col(c)) for c in detail})


def compare(rows: DataFrame, key: str, one, other, measures: dict[str, Column]) -> DataFrame:
    """measure with its value for two entities and the difference, long form."""
    agg = rows.filter(F.col(key).isin(one, other)).groupBy(key).agg(*[v.cast("double").alias(k) for k, v in measures.items()])
    long = agg.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in measures])))
    of = lambda x: F.max(F.when(F.col(key) == x, F.col("value")))
    return long.groupBy("measure").agg(of(one).alias("one"), of(other).alias("other")).withColumn("difference", F.coalesce("one", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))


#: Kinds of pictures that only stand in for one.
STAND_INS = r"(?i)\.svg($|[?#])|placeholder|favicon|avatar-default"


def picture_coverage(evidence: DataFrame) -> DataFrame:
    """platform with n_rows, n_pictures, n_stand_ins and n_missing of evidence (platform, picture)."""
    has = F.coalesce(F.col("picture"), F.lit("")) != ""
    stand_in = has & F.col("picture").rlike(STAND_INS)
    return evidence.groupBy("platform").agg(F.count("*").alias("n_rows"), F.count_if(has & ~stand_in).alias("n_pictures"), F.count_if(stand_in).alias("n_stand_ins"), F.count_if(~has).alias("n_missing"))


def audit_findings(evidence: DataFrame, nodes: DataFrame, *, expected: int, floors: dict[str, int], elapsed_ms: float, payload: int, reports: dict[str, bool]) -> DataFrame:
    """severity, check and n of what is wrong: the families of the quality audit, each an aggregate over rows or entities.

    evidence: id, entity_id, platform, score, state, source_url, at, post_key,
    profile. nodes: entity_id, score, platform_scores, best. Fixed thresholds; floors: least scored entities by platform.
    """
    spark = evidence.sparkSession
    scored = F.col("score") > 0
    e = evidence.agg(
        (F.count("*") - F.countDistinct("id")).alias("graph.duplicate_ids"), F.count_if(scored & (F.coalesce("source_url", F.lit("")) == "")).alias("evidence.scored_without_source"), F.count_if(scored & F.col("at").isNull()).alias("evidence.scored_without_time"),
        F.count_if(scored & (F.col("state") != "verified")).alias("evidence.scored_not_verified"), F.count_if(scored & F.col("profile")).alias("evidence.profile_scored"),
        *[F.greatest(F.lit(0), F.lit(k) - F.countDistinct(F.when(scored & (F.col("platform") == p), F.col("entity_id")))).alias(f"coverage.{p}") for p, k in floors.items()],
    )
    crossing = evidence.filter(scored & F.col("post_key").isNotNull()).groupBy("post_key").agg(F.countDistinct("entity_id").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicates.scored_post_cross_company"))
    rows_of = evidence.groupBy("entity_id").agg(F.count_if(scored).alias("n_scored"))
    n_on = F.size(F.filter(F.map_values("platform_scores"), lambda v: v > 0))
    g = nodes.join(rows_of, "entity_id", "left").agg(
        F.abs(F.count("*") - expected).alias("graph.entity_count"), F.count_if((F.col("score") >= 70) & (F.coalesce("n_scored", F.lit(0)) <= 2)).alias("scoring.high_score_sparse_evidence"),
        F.count_if((F.col("score") >= 80) & (n_on <= 1)).alias("scoring.high_score_one_platform"), F.count_if(F.col("best") <= 0).alias("ui.leaderboard_zero_contribution"),
    )
    counts = e.crossJoin(crossing).crossJoin(g)  # one row each
    severity = {"duplicates.scored_post_cross_company": "critical", "ui.leaderboard_zero_contribution": "critical", "graph.duplicate_ids": "high", "graph.entity_count": "high", "evidence.scored_without_source": "high", "evidence.scored_not_verified": "high"}
    level = lambda c: severity.get(c, "low" if c.startswith("coverage.") else "medium")
    found = counts.select(F.inline(F.array(*[F.struct(F.lit(level(c)).alias("severity"), F.lit(c).alias("check"), F.col(f"`{c}`").cast("long").alias("n")) for c in counts.columns]))).filter("n > 0")
    fixed = [("high" if elapsed_ms > 5_000 else "medium", "performance.slow", int(elapsed_ms))] if elapsed_ms > 2_000 else []
    fixed += [("medium", "performance.payload_large", payload)] if payload > 15_000_000 else []
    fixed += [("medium", f"observability.{name}_missing", 1) for name, there in reports.items() if not there]
    return found.unionByName(spark.createDataFrame(fixed, "severity string, check string, n long"))


def weakest(coverage: DataFrame, most: int = 75) -> DataFrame:
    """Entities with the fewest platforms: entity_id, have, lacking and place."""
    return coverage.withColumn("_n", F.size("have")).orderBy("_n", "entity_id").limit(most).drop("_n")


def run_summary(rows: DataFrame) -> DataFrame:
    """platform, rows, entities and the rows of one platform's best entity."""
    by = rows.groupBy("platform", "entity_id").agg(F.count("*").alias("n"))
    return by.groupBy("platform").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.max("n").alias("most"))


def last_failures(log: DataFrame, status: str, ordinal: str, most: int = 20) -> DataFrame:
    return log.filter(F.col(status) == "failed").orderBy(F.desc(ordinal)).limit(most)


def leaks(rows: DataFrame, entity: Column, pattern: str) -> DataFrame:
    """One row: how many rows an entity has, and how many of these speak of what a pattern finds."""
    return rows.filter(entity).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("text").rlike(pattern), F.lit(False))).alias("n_leaks"))


def review_priority(rows: DataFrame, flags: dict[str, int], most: int = 100) -> DataFrame:
    """`rows` (id, score, metrics) with points (the weights of the flags that hold) and priority: high from 4, medium from 2; the first `most` by priority, score and largest metric."""
    points = sum((F.when(F.coalesce(F.col(k), F.lit(False)), w).otherwise(0) for k, w in flags.items()), F.lit(0))
    out = rows.withColumn("points", points).withColumn("_top", F.coalesce(F.array_max(F.map_values("metrics")), F.lit(0.0)))
    rank = F.when(F.col("points") >= 4, 0).when(F.col("points") >= 2, 1).otherwise(2)
    named = F.when(F.col("points") >= 4, "high").when(F.col("points") >= 2, "medium").otherwise("low")
    return out.withColumn("priority", named).orderBy(rank, F.desc("score"), F.desc("_top"), "id").limit(most).drop("_top")
