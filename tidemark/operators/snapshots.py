"""Score snapshots in time and momentum against the day and the week before.

snapshots: batch, granularity (daily or weekly), recorded_at, entity_id, score, rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import micros
from tidemark.functions.num import jround


def baseline(snapshots: DataFrame, day: Column, days_back: int) -> DataFrame:
    """The last snapshot's rows of each batch on the calendar day `days_back` before."""
    on = snapshots.filter(F.to_date("recorded_at") == F.date_sub(day, days_back))
    last = on.groupBy("batch").agg(F.max("recorded_at").alias("recorded_at"))
    return on.join(last, ["batch", "recorded_at"], "left_semi")


def momentum(current: DataFrame, base: DataFrame, prefix: str) -> DataFrame:
    """`current` (entity_id, score, rank, and batch if there are several) with the change in score, in percent and in ranks against `base`; 0 where it has no row."""
    keys = [c for c in ("batch", "entity_id") if c in current.columns]
    b = base.select(*keys, F.col("score").alias("_score"), F.col("rank").alias("_rank"))
    out = current.join(b, keys, "left")
    delta = F.coalesce(F.col("score") - F.col("_score"), F.lit(0.0))
    percent = F.coalesce(delta / F.greatest("_score", F.lit(1.0)) * 100, F.lit(0.0))
    out = out.withColumns({f"{prefix}_delta": jround(delta, 1), f"{prefix}_percent": jround(percent, 1), f"{prefix}_ranks": F.coalesce(F.col("_rank") - F.col("rank"), F.lit(0))})
    return out.drop("_score", "_rank")


def retained(snapshots: DataFrame, keep: dict[str, int]) -> DataFrame:
    """The last snapshots of each batch and granularity, as many as `keep` says."""
    times = snapshots.select("batch", "granularity", "recorded_at").distinct()
    place = F.row_number().over(Window.partitionBy("batch", "granularity").orderBy(F.desc("recorded_at")))
    limit = F.create_map(*[F.lit(x) for k in keep.items() for x in k])[F.col("granularity")]
    kept = times.withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    return snapshots.join(kept, ["batch", "granularity", "recorded_at"], "left_semi")


def due(snapshots: DataFrame, now: Column) -> DataFrame:
    """batch, daily_due (none today) and weekly_due (none, or the last seven times 24 hours ago)."""
    last = lambda g: F.max(F.when(F.col("granularity") == g, F.col("recorded_at")))
    agg = snapshots.groupBy("batch").agg(last("daily").alias("d"), last("weekly").alias("w"))
    week = micros(now) - micros(F.col("w")) >= 7 * 24 * 3600 * 1_000_000
    return agg.select("batch", F.coalesce(F.to_date("d") != F.to_date(now), F.lit(True)).alias("daily_due"), F.coalesce(week, F.lit(True)).alias("weekly_due"))
