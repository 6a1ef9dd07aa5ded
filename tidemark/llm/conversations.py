"""Chat formatting: logged snapshots of a conversation collapse into the longest.

A running XOR over hashes of (place, role, text) gives a fingerprint of every
prefix of a conversation, in two halves of 64 bits. A conversation whose whole
fingerprint is that of a proper prefix of another, with the same number of
turns, is a snapshot of it and goes; of equal conversations the least id stays.
Both sides of that anti-join are made unique first, so a first turn that many
conversations share is one row. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tables import table


def _hashed(rows: DataFrame) -> DataFrame:
    """`rows` (place, role, text) with two hashes of each turn."""
    content = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return rows.withColumns({"h1": F.xxhash64(*content), "h2": F.xxhash64(F.lit("second"), *content)})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, n_turns and the prefix fingerprint (fp1, fp2) up to each turn.

    Turns go by `turn`, ties by role and text, nulls first. Turns without conv_id have no part in it.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = _hashed(turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order)))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    return out.select("conv_id", "place", "role", "text", F.count("*").over(whole).alias("n_turns"), F.bit_xor("h1").over(upto).alias("fp1"), F.bit_xor("h2").over(upto).alias("fp2"))


def lone(turns: DataFrame) -> DataFrame:
    """The different turns without conv_id, each a conversation of its own: conv_id (null), role, text, n_turns and its fingerprint."""
    rows = _hashed(turns.filter("conv_id IS NULL").select("conv_id", "role", "text").distinct().withColumn("place", F.lit(1)))
    return rows.select("conv_id", "role", "text", F.lit(1).cast("long").alias("n_turns"), F.col("h1").alias("fp1"), F.col("h2").alias("fp2"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations (conv_id, n_turns, fp1, fp2) that are a prefix of no other; of equal ones the least id, one without an id last."""
    rows, key = prefixes(turns), ["n_turns", "fp1", "fp2"]
    ends = rows.filter("place = n_turns").select("conv_id", *key).unionByName(lone(turns).select("conv_id", *key))
    whole = ends.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id"))["conv_id"].alias("conv_id"))
    proper = rows.filter("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "fp1", "fp2").distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", *key)


def _rendered() -> Column:
    """A turn as <|role|>, a line end, its text and <|end|>."""
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the conversation as text: its turns, parted by line ends."""
    rows = turns.select("conv_id", F.struct("turn", "role", "text", _rendered().alias("rendered")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list("t")).alias("t"))
    return out.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: x["rendered"]), "\n").alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """The rendered maximal conversations of `turns` (conv_id, turn, role, text).

    Null roles and texts are rendered as empty but differ from empty ones when
    conversations are compared. Each row without conv_id is a conversation of
    its own, of one turn; equal ones are one. Repeated rows are turns of their
    own where they have an id. Other columns are ignored.
    """
    kept = maximal(turns)
    rows = turns.join(kept.filter("conv_id IS NOT NULL").select("conv_id"), "conv_id", "left_semi")
    alone = lone(turns).join(kept.filter("conv_id IS NULL").drop("conv_id"), ["n_turns", "fp1", "fp2"], "left_semi")
    return render(rows.select("conv_id", "turn", "role", "text")).unionByName(alone.select("conv_id", "n_turns", _rendered().alias("text")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of the table, rendered."""
    return collapse(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT NULL, row_number() OVER (), role, text FROM (SELECT DISTINCT role, text FROM conversations WHERE conv_id IS NULL)
), k AS (SELECT *, CASE WHEN conv_id IS NULL THEN place END AS own FROM t
), c AS (
  SELECT conv_id, own, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS l,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>', chr(10) ORDER BY place) AS s FROM k GROUP BY 1, 2
)
SELECT a.conv_id, CAST(a.n AS BIGINT) AS n_turns, a.s AS text FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.l[1] IS NOT DISTINCT FROM a.l[1] AND (b.n > a.n AND b.l[1:a.n] = a.l OR b.n = a.n AND b.l = a.l AND (b.conv_id < a.conv_id OR a.conv_id IS NULL AND b.conv_id IS NOT NULL)))
"""
QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE = {"op9_chat_format": SQL}
