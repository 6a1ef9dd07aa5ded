"""The driver's tables as the tables that operators read.

events stand for evidence: the type is the platform, the user the entity, the
value and the number in `props` are metrics. The five types take the weights
and half-lives below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.config import Scoring

PLATFORMS = {"click": "x", "view": "instagram", "purchase": "github", "signup": "linkedin", "error": "web"}
EVENT_SCORING = Scoring()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, entity_id, platform, posted_at, metrics, raw (views 8 % and likes 1.5 of the number), eligible."""
    e = read(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for k in PLATFORMS.items() for x in k])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("double")
    metrics = F.create_map(F.lit("views"), F.col("value"), F.lit("likes"), k, F.lit("stars"), F.col("value"))
    return e.select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("entity_id"), name.alias("platform"), F.col("ts").alias("posted_at"), metrics.alias("metrics"), "value", k.alias("k"), (F.col("value") > 1).alias("eligible"))
