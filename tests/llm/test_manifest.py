import hashlib
import itertools
import zlib
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import manifest as m

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and for each leaf the siblings (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, i in zip(paths, at, strict=True):
            path.append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
        at, nodes = [i // 16 for i in at], [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, more in zip(sources, above, strict=True):
        for (_, _, own, r), path in zip(sorted(by[s]), trees[s][1], strict=True):
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path + more:
                node = sha(left + node + right)
            out.append((r[0], own, trees[s][0], root, sha("".join(itertools.chain(*path, *more))), node, node == root))
    return sorted(out, key=repr)


def built(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string, tree string")
    out = m.manifest(m.leaves_of(docs))
    out = out.select("doc_id", "leaf", "subroot", "root", m.proof(out["path"]).alias("proof_sha256"), m.fold(m.F.coalesce("tampered", "leaf"), out["path"]).alias("folded_root"))
    return sorted(map(tuple, out.withColumn("verified", m.F.col("folded_root") == m.F.col("root")).collect()), key=repr)


def test_whole_rows(spark):
    rows = [(i, f"s{i % 7 % 4}", "en", i, f"Text {i} Ä") for i in range(300)] + [(1000 + i, f"one{i:02}", None, None, "a") for i in range(20)]
    rows += [(None, None, None, None, None), (None, None, "", 0, ""), (5, "", "en", 1, "Equal"), (5, "", "en", 1, "Equal"), (5, "", "en", 2, "Equal"), (-3, "é\U0001f9ff", "de", 3, "ÀB"), (7, "s1", "en", 9, "X" * 100_000)]
    got = built(spark, rows)
    assert got == plain(rows)
    assert {x[6] for x in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_sizes(spark, n):
    rows = [(i, "s", "en", i, "Text") for i in range(n)]
    assert built(spark, rows) == (plain(rows) if n else [])


def test_given_documents(spark):
    """Against the plain tree and the SQL."""
    sf = "/root/testdata/sf0.001"
    got = m.op11_manifest(spark, sf).select(NAMES).collect()
    rows = [tuple(r[c] for c in m.FIELDS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf)}/documents.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({m.ORACLE['op11_manifest']})").fetchall(), key=repr) == plain(rows)
