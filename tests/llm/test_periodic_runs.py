import hashlib
import random
import re
import zlib

import numpy as np

from tidemark.llm import periodic_runs as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """Every stretch of each period that no neighbour extends; a stretch keeps its smallest period only."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def numbers(words):
    known = {}
    return np.array([0, *(known.setdefault(w, len(known) + 1) for w in words), 0])


def made(r, n):
    """A random text of pieces that repeat, with slips."""
    out = []
    while len(out) < n:
        piece = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 21]))]
        out += (piece * r.randint(1, 9))[: r.randint(1, 9 * len(piece))]
    return out[:n]


def test_runs_are_those_of_a_plain_search():
    r = random.Random(3)
    for k in range(600):
        words = made(r, r.randint(0, 160))
        got = [(a - 1, n, q) for a, n, q in p.runs_of(numbers(words)).tolist()]
        assert got == plain(words), (k, words)


def test_texts_are_searched_apart():
    z = np.concatenate([[0], [1] * 5, [0], [1] * 5, [0], [1] * 6, [0]])
    assert p.runs_of(z).tolist() == [[13, 6, 1]]
    assert p.runs_of(np.zeros(3, np.int64)).tolist() == []


def test_repetitive_and_long_texts_take_little_time():
    import time

    began = time.perf_counter()
    n = 400_000
    z = np.ones(n + 2, np.int64)
    z[0] = z[-1] = 0
    assert p.runs_of(z).tolist() == [[1, n, 1]]
    r = np.random.default_rng(1)
    z[1:-1] = np.resize(r.integers(1, 50, 70_001), n)
    assert [1, n, 70_001] in p.runs_of(z).tolist()
    assert time.perf_counter() - began < 60


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % period] for i in range(a, n)]
    runs = plain(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha, n)


def test_whole_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(made(r, r.randint(0, 120)))) for i in range(150)]
    rows += [(None, "x " * 9), (200, None), (201, ""), (202, " \t\x0b\x0c\n"), (202, "\x0ba\x85b\xa0 c\n" * 7), (3, rows[3][1]), (3, "x\x1cy " * 6), (204, "a b " * 3 + "c"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, [1]) for i, t in rows], "doc_id long, text string, n_words int, runs array<int>")
    got = p.digest(p.find_runs(p.planted(docs))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*x) for x in rows), key=repr)
    assert p.digest(p.find_runs(p.planted(docs.limit(0)))).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    got = p.digest(p.find_runs(p.planted(docs))).collect()
    want = [expected(x["doc_id"], x["text"]) for x in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(x["n_runs"] for x in got) > 5
