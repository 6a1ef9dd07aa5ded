"""Mixing sources to target weights by fitting a subset of lengths to each budget.

The plan sees documents only as counts by exact length. A source is taken as
often as its whole size fits its target, and the rest of the target is filled
from the counts: every length gives the share of its documents that the rest
is of the source, lengths whose share has the largest fraction give one more
while that fits, and a bounded-knapsack dynamic programme over the documents
that are still free fits what remains. Where that misses, as with few and very
long documents, less is given by shares and more is left to the programme,
until no subset can come nearer.
Documents are then chosen by a seeded hash until each length has its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tables import table
from tidemark.operators.ordering import numbered
from tidemark.session import durable

SEED = 20240607
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST_TIMES = 150, 2
#: Words that are left to the dynamic programme at first; its tables take about a bit for each word.
REACH = 1 << 16
#: Shortest lengths whose residues are tried, and most of residues times lengths; both decide the work, never the result.
PIVOTS, RESIDUES = 4, 1 << 26
#: Documents of one length that one bucket of the ranking holds, about.
RANKED = 512
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each row of `sizes` (source, source_size).

    Sources by code point, null last, weigh 5, 2, 1, and so on. All share 150 %
    of the whole; a target stops at twice its source, and the excess goes to
    the others by weight. That is a level: sources that twice their size keeps
    under it are full, and the others get the level by weight. It rises until
    no other source is full, one aggregate over the sources at a time, so there
    may be as many sources as there are sites.
    """
    rank = F.col("_rank") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = numbered(sizes.select("source", "source_size"), "_rank", F.col("source").asc_nulls_last())
    rows = durable(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size").cast("double") * MOST_TIMES).alias("cap")), "sources")
    level, n_full = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight") if n_full >= 0 else F.lit(False)
        got = rows.agg(F.sum(F.col("source_size").cast("double")), F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not got[3] or got[1] == n_full:
            break
        level, n_full = (got[0] * SHARE_PERCENT / 100 - (got[2] or 0.0)) / got[3], got[1]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _subset(sums: list[int], total: int) -> list[int]:
    """Places of `sums` that come to `total`, which a subset does: half of them from below meets the other half from above."""
    if not total:
        return []
    if len(sums) == 1:
        return [0]
    half, mask = len(sums) // 2, (1 << total + 1) - 1
    low, high = 1, 1 << total
    for x in sums[:half]:
        low |= low << x & mask if x <= total else 0
    for x in sums[half:]:
        high |= high >> x
    at = (low & high).bit_length() - 1
    return _subset(sums[:half], at) + [half + k for k in _subset(sums[half:], total - at)]


def knapsack(free: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length come nearest to `budget` from below; free: (length, count).

    Counts fall into powers of two. Sums that can be reached are the bits of
    one integer; the subset of the best is found by halves, in twice the time
    and a few integers of that size.
    """
    pieces = []
    for length, count in free:
        step = 1
        while count > 0 and length * min(step, count) <= budget:
            pieces.append((length, min(step, count)))
            count -= min(step, count)
            step *= 2
    mask = (1 << budget + 1) - 1
    reached, used = 1, 0
    while used < len(pieces) and not reached >> budget & 1:
        length, count = pieces[used]
        reached |= reached << length * count & mask
        used += 1
    out: dict[int, int] = {}
    for k in _subset([length * count for length, count in pieces[:used]], reached.bit_length() - 1):
        length, count = pieces[k]
        out[length] = out.get(length, 0) + count
    return out


def _words(taken: dict[int, int]) -> int:
    return sum(n * c for n, c in taken.items())


def _filled(counts: dict[int, int], taken: dict[int, int], rest: int) -> dict[int, int]:
    """`taken` and what the programme adds so that the words come nearest to `rest` from below."""
    left = rest - _words(taken)
    free = [(n, counts[n] - taken[n]) for n in sorted(counts, reverse=True) if n <= left and counts[n] > taken[n]]
    more = knapsack(free, left)
    return {n: taken[n] + more.get(n, 0) for n in counts if taken[n] + more.get(n, 0)}


def _fit(counts: dict[int, int], rest: int, reach: int) -> dict[int, int]:
    """By shares, with about `reach` words left to the programme."""
    whole = _words(counts)
    taken = {n: c * rest // whole for n, c in counts.items()}
    left = rest - _words(taken)
    # What the fit may still move: keep its reach, hand out the rest by the largest fraction, longest first among equals.
    for n in sorted(counts, key=lambda n: (-(counts[n] * rest % whole), -n)):
        if left - n >= min(reach, rest) // 2 and taken[n] < counts[n]:
            taken[n] += 1
            left -= n
    for n in sorted(counts, reverse=True):
        if left >= reach and taken[n] < counts[n]:
            more = min(counts[n] - taken[n], (left - reach // 2) // n)
            taken[n] += max(0, more)
            left -= n * max(0, more)
    return _filled(counts, taken, rest)


def _greedy(counts: dict[int, int], rest: int) -> dict[int, int]:
    """By shares, then the longest that still fit."""
    whole = _words(counts)
    taken = {n: c * rest // whole for n, c in counts.items()}
    left = rest - _words(taken)
    for n in sorted(counts, reverse=True):
        more = min(counts[n] - taken[n], left // n)
        taken[n] += more
        left -= n * more
    return taken


def _sure(counts: dict[int, int], rest: int) -> dict[int, int]:
    """How many of each length may be taken outright so that the programme over the others still finds a best subset.

    Take any subset within the longest length L of `rest`. A best one differs
    from it by at most 2 L documents: put the differences in an order in which
    their sums stay within L on both sides; among more than 2 L of them a sum
    comes twice, and what lies between can be left out of both.
    """
    return {n: max(0, c - 2 * max(counts)) for n, c in _greedy(counts, rest).items()}


def _moved(counts: dict[int, int], taken: dict[int, int], left: int, by: int) -> tuple[int, dict[int, int] | None]:
    """The most of `left` words that documents added to and removed from `taken` can come to, if as many of length `by` move as are wanted; and what to take then, if there are as many.

    Only residues modulo `by` decide: for each, a 0/1 programme over powers of
    two of the other lengths finds the fewest words that move to reach it. So
    the first figure is a bound on every subset, and with the second it is met.
    """
    cost = np.full(by, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    pieces = []
    for n in counts:
        for sign, most in ((1, counts[n] - taken[n]), (-1, taken[n])):
            step, most = 1, min(most, by - 1) if n % by else 0
            while most > 0:
                pieces.append((n, sign * min(step, most)))
                most -= min(step, most)
                step *= 2
    better = []
    for n, k in pieces:
        other = np.roll(cost, n * k % by) + n * abs(k)
        better.append(np.packbits(other < cost))
        cost = np.minimum(cost, other)
    most = next(d for d in range(left, -1, -1) if cost[d % by] < np.iinfo(np.int64).max // 8)
    out, r, words = dict(taken), most % by, most
    for (n, k), bits in zip(reversed(pieces), reversed(better), strict=True):
        if bits[r >> 3] >> (7 - (r & 7)) & 1:
            out[n] += k
            words -= n * k
            r = (r - n * k) % by
    out[by] += words // by
    return most, out if 0 <= out[by] <= counts[by] else None


def choose_counts(counts: dict[int, int], rest: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come nearest to `rest` from below.

    counts: documents by length (all above 0); rest is below their whole size.
    A fit by shares that meets `rest` (or its nearest multiple of what divides
    all lengths) is a best one. Otherwise residues modulo one of the shortest
    lengths bound what a subset can come to, and mostly give one that does.
    Where they do not, the reach grows until the bound is met or the programme
    runs over all that a best subset may move.
    """
    if rest <= 0 or not _words(counts):
        return {}
    best = rest // gcd(*counts) * gcd(*counts)
    taken = _fit(counts, rest, REACH)
    if _words(taken) == best:
        return taken
    start = _greedy(counts, rest)
    for by in sorted(counts)[:PIVOTS]:
        if by * len(counts) <= RESIDUES:
            most, moved = _moved(counts, start, rest - _words(start), by)
            best = min(best, _words(start) + most)
            if moved and _words(moved) == best:
                return {n: c for n, c in moved.items() if c}
    sure, reach = _sure(counts, rest), REACH
    while reach < rest - _words(sure):
        taken = _fit(counts, rest, reach)
        if _words(taken) == best:
            return taken
        reach *= 16
    return _filled(counts, sure, rest)


def _plan(key: tuple, group: pa.Table) -> pa.Table:
    """One source: its histogram (length, count) with source_size and target to (length, count, whole, extra)."""
    lengths, n = group.column("size").to_pylist(), group.column("count").to_pylist()
    size, target = group.column("source_size")[0].as_py(), round(group.column("target")[0].as_py())
    whole = target // size if size else 0
    extra = choose_counts({a: b for a, b in zip(lengths, n, strict=True) if a}, target - whole * size)
    rows = {"source": group.column("source"), "size": lengths, "count": n, "whole": [whole] * len(n), "extra": [extra.get(a, 0) for a in lengths]}
    return pa.table(rows, schema=pa.schema([("source", pa.string()), ("size", pa.int64()), ("count", pa.int64()), ("whole", pa.int64()), ("extra", pa.int64())]))


def mix_plan(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """`sized` (source, size, and `key`, a unique string or number) with source_size, target and times, how often to take each row."""
    counts = durable(sized.groupBy("source", "size").agg(F.count("*").alias("count")), "lengths")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")))
    joined = counts.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = joined.groupBy("source").applyInArrow(_plan, "source string, size long, count long, whole long, extra long")
    plan = durable(plan.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "plan")
    right = plan.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "source_size", "target", "whole", "extra", "count")
    rows = sized.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))).drop("_s", "_n")
    # The first `extra` of a length by hash: buckets of the hash are counted, and rows ranked within theirs.
    draw = F.xxhash64(F.lit(seed), "key")
    n_buckets = F.ceil(F.col("count") / RANKED)
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("count")), F.floor(F.shiftrightunsigned("draw", 33) * n_buckets / F.lit(2.0**31))).cast("int"))
    open_ = durable(rows.filter("bucket IS NOT NULL"), "ranked")
    sums = open_.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    earlier = sums.select(F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("bucket").alias("_b"), (F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")).alias("earlier"))
    near = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "key"))
    ranked = open_.withColumn("near", near).join(earlier, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")) & (F.col("bucket") == F.col("_b")))
    picked = ranked.withColumn("times", F.col("whole") + (F.col("earlier") + F.col("near") <= F.col("extra")).cast("long"))
    plain = rows.filter("bucket IS NULL").withColumn("times", F.col("whole") + (F.col("extra") > 0).cast("long"))
    columns = [*sized.columns, "source_size", "target", "times"]
    return plain.select(columns).union(picked.select(columns))


def _key() -> Column:
    return F.struct("doc_id", "source", F.xxhash64("text").alias("hash"))


def mix_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and times of every row of `docs` (doc_id, text, source).

    size counts words of the whole text, none for null. taken is size by times.
    A document of no words is taken as often as its whole source is. Rows are
    told apart by doc_id, source and the text's hash, so reruns agree; rows equal
    in all may stand for each other. An empty table gives an empty one.
    """
    sized = durable(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _key().alias("key")), "sizes")
    return mix_plan(sized, seed).select("doc_id", "key", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with their own columns only.

    Rows with the same key share what their key is taken, the first ones once more than the others.
    """
    times = mix_sizes(docs, seed).groupBy("key").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).filter("times > 0")
    rows = docs.select(F.struct("*").alias("_row"), _key().alias("_key"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    each = F.floor(F.col("times") / F.col("rows")) + (F.col("_place") <= F.col("times") % F.col("rows")).cast("int")
    out = rows.join(times, rows["_key"].eqNullSafe(times["key"])).select("_row", each.cast("int").alias("_times")).filter("_times > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; null and empty texts have size 0, a null source is one of its own, the last in order."""
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE: dict[str, str] = {}
