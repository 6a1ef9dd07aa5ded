"""Duplicates: keys, survivors, last-wins, ordered merges, and reports of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import freshness, lenient
from tidemark.functions.text import fingerprint, key_part
from tidemark.functions.urls import canonical_url


def evidence_key(platform: Column, post: Column, url: Column, account: Column, author: Column, text: Column) -> Column:
    """The post's id, else its canonical URL, else account with the first 220 characters of author and text."""
    canonical = canonical_url(url)
    fallback = F.substring(key_part(F.concat_ws(":", F.coalesce(author, F.lit("")), F.coalesce(text, F.lit("")))), 1, 220)
    return (
        F.when(F.coalesce(post, F.lit("")) != "", F.concat(platform, F.lit(":post:"), key_part(post)))
        .when(canonical != "", F.concat(platform, F.lit(":url:"), canonical))
        .otherwise(F.concat(platform, F.lit(":fallback:"), key_part(account), F.lit(":"), fallback))
    )


def evidence_freshness(*texts: Column) -> Column:
    return freshness(*[lenient(t) for t in texts])


def fresh_survivors(rows: DataFrame, key: str, times: list[str], contribution: str = "contribution", metrics: str = "metrics", ordinal: str = "ordinal") -> DataFrame:
    """Of each key the row that is freshest by its times (texts), then that of the largest contribution * 1e6 + sum of metrics; ties keep the first."""
    total = F.aggregate(F.map_values(metrics), F.lit(0.0), lambda n, v: n + F.coalesce(v, F.lit(0.0)))
    return survivors(rows, [key], evidence_freshness(*[F.col(t) for t in times]).desc(), (F.coalesce(contribution, F.lit(0.0)) * 1e6 + total).desc(), ordinal=ordinal)


def survivors(rows: DataFrame, keys: list[str], *rank: Column | str, ordinal: str = "ordinal") -> DataFrame:
    """The best row of each key; ties keep the first."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank, ordinal))).filter("_place = 1").drop("_place")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key, at the place (first_ordinal) of its first. One aggregate, no window."""
    others = [c for c in rows.columns if c not in keys]
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), ordinal).alias("_last"), F.min(ordinal).alias("first_ordinal"))
    return agg.select(*keys, "_last.*", "first_ordinal")


def merge_fields(rows: DataFrame, keys: list[str], kept: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key, but of `kept` fields the last value that is not empty."""
    filled = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(ordinal)))
    plain = [c for c in rows.columns if c not in (*keys, *kept, ordinal)]
    return rows.groupBy(*keys).agg(F.max(ordinal).alias(ordinal), *[filled(c).alias(c) for c in kept], *[F.max_by(c, ordinal).alias(c) for c in plain])


#: Which state holds when rows of one key are merged.
STATE_RANK = {"rejected": 6, "verified": 5, "needs_review": 4, "failed": 3, "no_results": 2}


def state_rank(state: Column) -> Column:
    out = F.lit(1)
    for name, rank in STATE_RANK.items():
        out = F.when(state == name, rank).otherwise(out)
    return out


def merge_states(rows: DataFrame, keys: list[str], state: str = "state", ordinal: str = "ordinal") -> DataFrame:
    """keys with the state of the highest rank (ties: the last), how often it was tried, first and last ordinal, and how often the state changed in order."""
    place = F.struct(state_rank(F.col(state)).alias("rank"), F.col(ordinal).alias("o"))
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(ordinal))
    rows = rows.withColumn("_changed", F.coalesce(F.col(state) != before, F.lit(False)).cast("long"))
    return rows.groupBy(*keys).agg(F.max_by(state, place).alias(state), F.count("*").alias("n_attempts"), F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"), F.sum("_changed").alias("n_changes"))


def without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def own_accounts(accounts: DataFrame, members: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """`accounts` of entities without those of their members, each key (the entity and the account) once: the first row stays."""
    left = without(accounts, members, keys)
    first = left.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in left.columns if c not in keys]), ordinal).alias("_first"))
    return first.select(*keys, "_first.*").select(*accounts.columns)


def groups(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """key, count and number of owners of keys with more than one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(owner).alias("n_owners")).filter("n > 1")


def near_duplicates(rows: DataFrame, text: str, owner: str, platform: str, score: str, least: int = 28, most_platforms: int = 2) -> DataFrame:
    """fingerprint, n, n_owners and n_platforms of scored rows whose fingerprint, of at least `least` characters, several owners share on at most two platforms."""
    keyed = rows.filter(F.col(score) > 0).withColumn("fingerprint", fingerprint(F.col(text))).filter(F.length("fingerprint") >= least)
    found = keyed.groupBy("fingerprint").agg(F.count("*").alias("n"), F.countDistinct(owner).alias("n_owners"), F.countDistinct(platform).alias("n_platforms"))
    return found.filter((F.col("n_owners") > 1) & (F.col("n_platforms") <= most_platforms))


#: Which source of an entity's record is better.
RELIABILITY = {"high": 3, "medium": 2, "low": 1}


def reliability_rank(value: Column) -> Column:
    out = F.lit(0)
    for name, rank in RELIABILITY.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def by_reliability(rows: DataFrame, key: str, reliability: str = "reliability", ordinal: str = "ordinal") -> DataFrame:
    """One row for each key: of the best source, of equal ones the first."""
    return survivors(rows, [key], reliability_rank(F.col(reliability)).desc(), ordinal=ordinal)


def strongest_reliability(rows: DataFrame, keys: list[str], reliability: str = "reliability") -> DataFrame:
    """keys and the best reliability of their rows; none where there is no known one."""
    best = F.max(F.struct(reliability_rank(F.col(reliability)).alias("r"), F.col(reliability).alias("v")))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.when(F.col("_b.r") > 0, F.col("_b.v")).otherwise("none").alias("reliability"))


def review_state_of(reliability: Column) -> Column:
    return F.when(reliability == "high", "verified").otherwise("needs_review")


def duplicate_groups(rows: DataFrame, key: str, row_id: str, url: str, at: str, most_ids: int = 10) -> DataFrame:
    """key, n, up to `most_ids` ids and addresses in order, and the latest date, of keys with more than one row."""
    some = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, most_ids)
    often = rows.join(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), key)
    return often.groupBy(key).agg(F.max("n").alias("n"), some(row_id).alias("ids"), some(url).alias("urls"), F.max(at).alias("latest"))


def duplicate_accounts(entity_accounts: DataFrame, member_accounts: DataFrame, key: Column) -> DataFrame:
    """entity_id, account and n: accounts (entity_id, platform, url, handle) that an entity has more than once, its members' included."""
    rows = entity_accounts.unionByName(member_accounts).withColumn("account", F.concat_ws(":", "platform", key))
    return rows.groupBy("entity_id", "account").agg(F.count("*").alias("n")).filter("n > 1")
