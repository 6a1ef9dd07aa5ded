"""Incremental forms of batch steps: resume, idempotent upsert, snapshots gated by day. Replays give the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidemark.operators.dedupe import last_wins
from tidemark.operators.snapshots import due, retained
from tidemark.session import exists


def pending(tasks: DataFrame, log: DataFrame, key: str = "task_key", *, force: bool = False) -> DataFrame:
    """Tasks that the log does not have as done."""
    return tasks if force else tasks.join(log.filter("status = 'done'").select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: the highest version, and of equal ones the incoming."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    ordered = both.withColumn("_order", F.struct(version, "_new")).drop("_new")
    return last_wins(ordered, [key], "_order").drop("first_ordinal", "_order").select(*stored.columns)


def running_scores(events: DataFrame, at: str, entity: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by entity and window of event time; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), entity).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), entity, "total", "n")


def once_per_id(events: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


#: Buckets of a table of upserts: the most entries of its manifest.
BUCKETS = 256


def write_upserts(stream: DataFrame, path: str, key: str, version: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Upserts each micro-batch into `path`, a table that one stream with one checkpoint writes.

    Keys are hashed into buckets. A batch reads and rewrites the buckets that it
    touches, into data/v<epoch>, and then commits a manifest, the version that
    each bucket has: a row for each bucket. An epoch whose manifest is there is
    a replay and changes nothing; one that died before is written anew. `buckets`
    stays as it was when the table began.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{path}/manifest/v{epoch}/_SUCCESS"):
            return
        rows = batch.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets))).persist()
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        held = _manifest(spark, path, epoch - 1)
        old = _read_buckets(spark, path, {b: v for b, v in held.items() if b in touched}, batch.schema)
        merged = upsert(old, rows.drop("bucket"), key, version).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{epoch}")
        now = held | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{epoch}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _manifest(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """The version of each bucket as of an epoch; each epoch commits one, so the one before is there or the table is new."""
    if epoch < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/v{epoch}").collect()}


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())])


def read_upserts(spark: SparkSession, path: str, schema: StructType, epoch: int) -> DataFrame:
    """The table of upserts as of an epoch; earlier ones stay readable."""
    return _read_buckets(spark, path, _manifest(spark, path, epoch), schema)


def replay(spark: SparkSession, batches: list[DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Folds batches with a step, as the stream does."""
    out = batches[0].limit(0)
    for b in batches:
        out = step(out, b)
    return out


def recorded(stored: DataFrame, current: DataFrame, now: Column, keep: dict[str, int]) -> DataFrame:
    """`stored` snapshots with `current` (batch, entity_id, score, rank) as today's and this week's where they are due, and what is retained."""
    gates = current.select("batch").distinct().join(due(stored, now), "batch", "left")
    rows = []
    for granularity, gate in (("daily", "daily_due"), ("weekly", "weekly_due")):
        open_ = gates.filter(F.coalesce(gate, F.lit(True))).select("batch")
        rows.append(current.join(open_, "batch", "left_semi").withColumn("granularity", F.lit(granularity)).withColumn("recorded_at", now))
    return retained(stored.unionByName(rows[0].select(*stored.columns)).unionByName(rows[1].select(*stored.columns)), keep)


def cooling(failures: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """platform and until, of platforms (a row each; the stream of them is in `cooldown`) whose last refusal (platform, at, refused) has not yet expired."""
    last = failures.filter("refused").groupBy("platform").agg(F.max("at").alias("at"))
    return last.withColumn("until", F.col("at") + F.make_interval(mins=F.lit(minutes))).filter(F.col("until") > now).select("platform", "until")
