"""Places and running sums in an order over all rows, without a task that holds all of them.

Rows are dealt by ranges of the order and written; the few sums by range tell
where each range begins. A hot key or a table without keys is spread like any
other, as ranges cut through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import durable

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: the partition above 33 bits, the row's place within it below


def _placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    seq = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    return durable(seq, "placed").withColumn("_part", F.shiftright("_seq", 33))


def numbered(rows: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """`rows` with `out`, the place of each from 1 in an order that leaves no ties."""
    placed = _placed(rows, list(order))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row for each range
    place = F.col("_base") + F.col("_seq").bitwiseAND(F.lit(_WITHIN)) + 1
    return placed.join(F.broadcast(base), "_part").withColumn(out, place).drop("_part", "_seq", "_base")


def running(rows: DataFrame, keys: list[str], value: str, amount: str, out: str, whole: str) -> DataFrame:
    """`rows` (one for each of keys and value) with the sum of `amount` up to and with each value within its keys, and over all of these."""
    placed = _placed(rows, [*keys, value])
    within = F.sum(amount).over(Window.partitionBy("_part", *keys).orderBy("_seq"))
    sums = placed.groupBy("_part", *keys).agg(F.sum(amount).alias("_n"))
    by_key = Window.partitionBy(*keys)  # a row for each range that a key reaches into
    base = sums.select("_part", *keys, (F.sum("_n").over(by_key.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_n").over(by_key).alias(whole))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_part", *keys)]
    both = placed.withColumn("_within", within).alias("a").join(base.alias("b"), on)
    return both.select("a.*", (F.col("b._base") + F.col("a._within")).alias(out), f"b.{whole}").drop("_part", "_seq", "_within")
