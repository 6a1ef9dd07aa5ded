"""Merkle manifest: a root over all rows, a root for each source, and proofs.

Rows are leaves, in a tree for each source, whose roots are the leaves of one
tree more. A level is a window: the nodes of a parent lie in one frame of
FAN at most, and the ordered list of the whole frame is both what the parent
hashes and what each node has for siblings. Parents, one for each frame, are
the next level. From the top down each node then gets its path, the siblings
to its left and right at every level, of which proofs and folds are made.

Leaves are numbered by ranges of (source, doc_id), so a source that holds most
rows is cut into many ranges, and a frame never holds more than FAN nodes.
"""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tables import table
from tidemark.operators.ordering import running
from tidemark.session import durable

#: Children of a parent.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """sha256 of the values: each its length in bytes, a colon and itself, or - where it is null."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` (tree, key, node, row) with place, from 0 in the order of key within their tree, and n, the nodes of the tree."""
    out = running(rows.withColumn("_one", F.lit(1)), ["tree"], "key", "_one", "place", "n")
    return durable(out.select("tree", (F.col("place") - 1).alias("place"), "n", "node", "row"), "nodes")


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from their leaves up, and their roots (tree, height, node). A level has the nodes of trees that have others at that height, and `frame`, the nodes of the same parent in order."""
    whole = Window.partitionBy("tree", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.filter("n = 1").select("tree", F.lit(0).alias("height"), "node")
    while largest > FAN ** len(levels):
        more = nodes.filter("n > 1").withColumn("parent", F.expr(f"place div {FAN}"))
        level = durable(more.withColumn("frame", F.collect_list("node").over(whole)), "level")
        levels.append(level)
        first = level.filter(f"place % {FAN} = 0")
        nodes = first.select("tree", F.col("parent").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.array_join("frame", ""), 256).alias("node"))
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "node"))
    return levels, roots


def _paths(nodes: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The columns of `row` of all leaves, and those of `roots` (tree, height, path and others) for their tree, with their own path before that of the root."""
    kept = [c for c in roots.columns if c not in ("tree", "height", "path")]
    out = nodes.filter("n = 1").join(roots.filter("height = 0"), "tree").select("row.*", "path", *kept)
    at, above = F.expr(f"int(place % {FAN})"), None
    step = F.struct(F.array_join(F.slice("frame", F.lit(1), at), "").alias("left"), F.array_join(F.slice("frame", at + 2, F.lit(FAN)), "").alias("right"))
    for height in reversed(range(len(levels))):
        tops = roots.filter(F.col("height") == height + 1).select("tree", F.lit(0).cast("long").alias("parent"), "path", *kept)
        above = tops if above is None else above.unionByName(tops)
        joined = levels[height].withColumn("_step", step).join(above, ["tree", "parent"])
        path = F.concat(F.array("_step"), "path").alias("path")
        if height:
            above = durable(joined.select("tree", F.col("place").alias("parent"), path, *kept), "paths")
        else:
            out = out.unionByName(joined.select("row.*", path, *kept))
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """`leaves` (source, doc_id, leaf and others) with subroot, root and path: (left, right), the siblings to each side, level by level up to the root.

    Leaves of a source lie by doc_id, null first; those with equal doc_id by
    their digest. Sources lie by their bytes, null first. The last parent of a
    level may have one child; a source or table of one leaf has no level. No
    leaves give no rows.
    """
    rows = leaves.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"), F.struct("doc_id", "leaf").alias("key"), F.col("leaf").alias("node"), F.struct(*leaves.columns).alias("row"))
    nodes = _placed(durable(rows, "leaves"))
    levels, subroots = _grown(nodes)
    row = F.struct(F.col("tree").alias("source_tree"), "height", F.col("node").alias("subroot"))
    tops = _placed(durable(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node", row.alias("row")), "subroots"))
    above, root = _grown(tops)
    root = root.select("tree", "height", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node").alias("root"))
    of_sources = durable(_paths(tops, above, root), "sources").withColumnRenamed("source_tree", "tree")
    return _paths(nodes, levels, of_sources)


def fold(node: Column, path: Column) -> Column:
    """The root that `node` has with the siblings of its path."""
    return F.aggregate(path, node, lambda x, step: F.sha2(F.concat(step["left"], x, step["right"]), 256))


def proof(path: Column) -> Column:
    """sha256 of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """source, doc_id and leaf of every row of `docs`, and tampered: the leaf with A to Z of the text lower-cased where 5 divides crc32 of the decimal doc_id, else null. Null doc_ids are left alone."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return docs.select("source", "doc_id", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(hit, leaf([changed if c == "text" else F.col(c) for c in FIELDS])).alias("tampered"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, proven against the root; nulls hash as a dash, equal rows are leaves of their own."""
    out = manifest(leaves_of(table(spark, sf_dir, "documents")))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """The same rows, for sources of up to FAN ** levels rows and as many sources."""
    values = ["doc_id", "source", "lang", "n_chars", "{text}"]
    hashed = "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in values) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, (c & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, 1 + strlen(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))), lambda a, b: {bits}), 4294967295)"
    parts = [
        f"l AS (SELECT doc_id, source, {hashed.format(text='text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed.format(text=lower)} END AS tampered FROM documents)",
        "s0 AS (SELECT source AS tree, doc_id, leaf, tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM l)",
    ]

    def grow(name: str) -> None:
        for k in range(levels):
            w = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}w{k} AS (SELECT tree, i, n, node, coalesce(string_agg(node, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le, "
                f"coalesce(string_agg(node, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {name}{k})"
            )
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, any_value((n + 15) // 16) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node FROM {name}{k} GROUP BY ALL)")

    def climb(name: str, start: str, of: str) -> str:
        """Each row of `start` (tree, i, f, p) with f folded and p longer by the levels of the tree."""
        for k in range(levels):
            parts.append(
                f"{of}{k + 1} AS (SELECT a.* REPLACE (CASE WHEN b.n > 1 THEN sha256(b.le || a.f || b.ri) ELSE a.f END AS f, a.p || CASE WHEN b.n > 1 THEN b.le || b.ri ELSE '' END AS p) "
                f"FROM {start if k == 0 else of + str(k)} a JOIN {name}w{k} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.i // {FAN**k} = b.i)"
            )
        return f"{of}{levels}"

    grow("s")
    parts.append(f"u0 AS (SELECT 1 AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, node FROM s{levels})")
    grow("u")
    parts.append("a0 AS (SELECT doc_id, leaf, tree, i, coalesce(tampered, leaf) AS f, '' AS p FROM s0)")
    low = climb("s", "a0", "a")
    parts.append(f"b0 AS (SELECT a.doc_id, a.leaf, u.node AS subroot, u.tree, u.i, a.f, a.p FROM {low} a JOIN u0 u ON a.tree IS NOT DISTINCT FROM u.source)")
    high = climb("u", "b0", "b")
    return f"WITH {', '.join(parts)} SELECT b.doc_id, b.leaf, b.subroot, r.node AS root, sha256(b.p) AS proof_sha256, b.f AS folded_root, b.f = r.node AS verified FROM {high} b, u{levels} r"


QUERIES = {"op11_manifest": op11_manifest}
ORACLE = {"op11_manifest": _sql()}
