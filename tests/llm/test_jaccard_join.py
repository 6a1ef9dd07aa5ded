import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join as j
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets

DOCS = "doc_id long, text string"


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, families=12, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 4, 5, 6, 9, 30, 120, 400]))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.randint(1, copies)):
            t = base.copy()
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 2)] = [word()] * r.randint(0, 2)
            texts.append(r.choice([" ", "\n", "\t "]).join(t))
    texts += ["", None, " \n ", "one two", "One TWO", "one two", texts[0]]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = j.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("flush,small,tile,seed", [(1 << 20, 2, 4, 4), (60, 2, 3, 5), (60, 64, 4096, 6)])
def test_components_in_large_blocks(spark, monkeypatch, flush, small, tile, seed):
    """Blocks that many classes share, combined by flushes and cut into tiles."""
    for name, value in (("FLUSH_KEYS", flush), ("SMALL", small), ("TILE", tile), ("BUCKET_KEYS", 300)):
        monkeypatch.setattr(j, name, value)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    texts = []
    for size, copies, edits in ((60, 24, 3), (60, 16, 9), (12, 20, 1), (200, 12, 30)):
        base = [word() for _ in range(size)]
        for _ in range(copies):  # some link, some are near without linking
            t = base.copy()
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = j.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows)


def test_nulls_repeats_ties_extra_columns_and_long_texts(spark):
    long = " ".join(str(k) for k in range(60_000))
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (7, None), (7, ""), (9, long), (8, long + " x"), (5, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS + ", component_id string, sig int, n int")
    got = j.jaccard_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, "A b c d e f"), (7, None), (7, ""), (8, long + " x")], key=repr)


def test_empty_table(spark):
    assert j.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert j.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_that_link_share_a_block_key():
    r = random.Random(5)
    none = np.zeros(0, np.uint64)
    for _ in range(400):
        n = r.choice([5, 6, 8, 13, 50, 300])
        words = [str(r.random()) for _ in range(n + 4)]
        other = words.copy()
        for _ in range(r.randint(0, n // 20 + 1)):
            other[r.randrange(len(other))] = "x" + str(r.random())
        a, b = shingle_sets([" ".join(words).encode(), " ".join(other).encode()])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            frequent = np.sort(a[:: r.randint(1, 3)])
            for f in (none, frequent):
                assert len(np.intersect1d(j.block_keys(a, f), j.block_keys(b, f)))


def test_sketch_distance_never_exceeds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[:200], r.integers(0, 1 << 63, 40).astype(np.uint64)]))
        x, y = j.parity_sketch(a, 1024), j.parity_sketch(b, 512)
        assert int(np.bitwise_count(j.folded(x, 8) ^ y).sum()) <= len(np.setxor1d(a, b))


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
