"""Ranked views. Ties always end with `ordinal`, the place in the source, so ranks are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.num import jround
from tidemark.operators.ordering import numbered, running


def leaderboard(entities: DataFrame, score: str = "total", ordinal: str = "ordinal") -> DataFrame:
    """`entities` with rank."""
    return numbered(entities, "rank", F.desc(score), ordinal).withColumn("rank", F.col("rank").cast("int"))


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def best_row(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def at_most_share(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The share of values that are at most this one, within the keys; nulls count as the least value."""
    counts = running(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, "_n", "_upto", "_whole")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, value)]
    return rows.alias("a").join(counts.alias("b"), on).select("a.*", (F.col("b._upto") / F.col("b._whole")).alias(out))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, fraction: float, out: str) -> DataFrame:
    """keys and the lower nearest-rank quantile, sorted[floor((n - 1) * fraction)]."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    place = F.floor((F.col("_whole") - 1) * fraction) + 1
    held = running(counts, keys, value, "_n", "_upto", "_whole").filter((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place))
    return held.select(*keys, F.col(value).alias(out))


def radius(rows: DataFrame, score: str, low: float, high: float, power: float = 2.2) -> DataFrame:
    """`rows` with radius: the place of the score between the extremes of all rows, to a power; a half where all are equal."""
    ends = rows.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    place = F.coalesce((F.col(score) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.5))
    return rows.crossJoin(F.broadcast(ends)).withColumn("radius", low + F.pow(place, F.lit(power)) * (high - low)).drop("_low", "_high")


def fastest_gaining(entities: DataFrame, now: str, before: str, ordinal: str = "ordinal") -> DataFrame:
    """`entities` (`ordinal` is unique) with both ranks, the gain in score and in ranks, in order of gain. Both boards are ranked in one pass."""
    place = lambda c: F.struct(F.col(c).isNull().alias("last"), (-F.col(c)).alias("value"), F.col(ordinal).alias("ordinal"))
    both = entities.select(ordinal, F.inline(F.array(*[F.struct(F.lit(out).alias("_board"), place(c).alias("_place")) for c, out in ((now, "rank_now"), (before, "rank_before"))])))
    ranks = running(both.withColumn("_one", F.lit(1)), ["_board"], "_place", "_one", "_rank", "_all").groupBy(ordinal).agg(
        *[F.max(F.when(F.col("_board") == out, F.col("_rank"))).cast("int").alias(out) for out in ("rank_now", "rank_before")]
    )
    out = entities.join(ranks, ordinal)
    out = out.withColumn("gain", jround(F.col(now) - F.col(before), 2)).withColumn("rank_gain", F.col("rank_before") - F.col("rank_now"))
    return numbered(out, "place", F.desc("gain"), F.desc("rank_gain"), F.desc(now), ordinal).withColumn("place", F.col("place").cast("int"))


def lanes(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Round-robin over n lanes in the given order."""
    return numbered(rows, "lane", *order).withColumn("lane", ((F.col("lane") - 1) % n).cast("int"))


def movers(base: DataFrame, other: DataFrame, key: str, score: str, missing_rank: int = 999) -> DataFrame:
    """key, rank in either table (999 where missing) and the move."""
    rank = lambda df, out: numbered(df.select(key, score), out, F.desc(score), key).select(key, F.col(out).cast("int").alias(out))
    both = rank(other, "rank_other").join(rank(base, "rank_base"), key, "left").withColumn("rank_base", F.coalesce("rank_base", F.lit(missing_rank)))
    return both.withColumn("move", F.col("rank_base") - F.col("rank_other"))


def biggest_movers(base: DataFrame, other: DataFrame, key: str, score: str, most: int = 25) -> DataFrame:
    """The rows of `movers` that moved most either way, those of equal moves by their rank."""
    return movers(base, other, key, score).orderBy(F.desc(F.abs("move")), "rank_other").limit(most)


def feed(rows: DataFrame, sort: str, k: int = 20, *, ascending: bool = False, ordinal: str = "ordinal") -> DataFrame:
    """The first `k` of `rows` (posted_at, metrics, platform, contribution) by the reader's choice: newest, views, likes, comments, platform or contribution; unknown values count 0, platforms go by name."""
    keys = {"newest": F.col("posted_at"), "platform": F.col("platform"), "contribution": F.coalesce("contribution", F.lit(0.0))}
    key = keys.get(sort, F.coalesce(F.try_element_at("metrics", F.lit(sort)), F.lit(0.0)))
    up = ascending != (sort == "platform")
    return rows.orderBy(key.asc_nulls_last() if up else key.desc_nulls_last(), ordinal).limit(k)
