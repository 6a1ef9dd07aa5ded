import hashlib
import random
import time

import numpy as np
import pytest

from tidemark.llm import decontaminate as d


def words(t):
    return d.words(t.encode() if t is not None else None)


def brute(rows, bench, size=10):
    windows = {}
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=repr)


def digest(found):
    return sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), list(r.items)) for r in [_row(x) for x in found.collect()]), key=repr)


class _row:
    def __init__(self, r):
        self.doc_id, self.n_words, self.spans, self.items = r["doc_id"], r["n_words"], r["spans"], r["items"]


@pytest.mark.parametrize("seed,block", [(1, 1 << 26), (2, 1 << 26), (3, 300)])
def test_hits_are_those_of_comparing_all_windows(spark, seed, block):
    r = random.Random(seed)
    vocabulary = ["Ab", "c", "é", "12", "dd", "e", "f", "g"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [(k, text(r.choice([1, 2, 9, 10, 11, 30]))) for k in range(12)] + [(None, text(12)), (3, None), (4, ""), (5, text(12)), (5, text(13))]
    bench = [b for b in bench if b[1] is None or len(b[1].split()) != 1] + [(77, "zz")]
    rows = [(k, text(r.randint(0, 80))) for k in range(30)] + [(99, None), (98, ""), (97, "zz, ZZ-zz")]
    for k in range(20):
        b = r.choice(bench)[1] or ""
        rows.append((200 + k, text(r.randint(0, 9)) + "!? " + b.upper().replace(" ", ", ") + "-" + text(5)))
    found = d.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)
    assert digest(found) == brute(rows, bench)


def test_no_benchmark_no_documents_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, spans string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:] for r in d.find_contamination(docs, none).collect()] == [(2, [], [])]
    assert d.decontaminate(docs, none).collect() == docs.collect()
    assert d.find_contamination(docs.limit(0), none).count() == 0


def test_cutting_leaves_the_rest(spark):
    item = "q w e r t y u i o p a s"
    docs = spark.createDataFrame([(1, f"Start, {item.upper()}! end é.", 9), (2, item, 9), (3, "clean text", 10), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in d.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: ("Start! end é.", 13), 3: ("clean text", 10), 4: (None, 0)}


def test_fm_index_finds_and_locates_every_pattern():
    r = np.random.default_rng(3)
    runs = [r.integers(1, 5, r.integers(1, 40)) for _ in range(20)]
    text = np.concatenate([np.append(x, 0) for x in runs])
    index = d.FMIndex(text, 5)
    for n in (1, 2, 4):
        patterns = np.unique(r.integers(1, 5, (40, n)), axis=0)
        low, high = index.search(patterns, np.full(len(patterns), n))
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_items_hash_is_of_sorted_strings(spark, tmp_path):
    rows = [(1, " ".join("abcdefghijkl"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, " ".join("abcdefghij")), (9, " ".join("bcdefghijk"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (r,) = d.op3_decontaminate(spark, str(tmp_path)).collect()
    assert tuple(r) == (1, 12, 11, 2, hashlib.sha256(b"10,9").hexdigest(), True)


def test_cutting_takes_one_pass_over_a_long_text():
    n = 300_000
    text = b"".join(b"- W%d" % i for i in range(n)) + b"!"
    spans = [{"first": i, "last": i + 1} for i in range(0, n, 4)]
    began = time.process_time()
    out = d.without(text, spans)
    assert time.process_time() - began < 5
    assert out == b"".join(b"- W%d" % i for i in range(n) if i % 4 > 1) + b"!"


@pytest.mark.parametrize("shard,chunk", [(7, 1 << 20), (50, 40), (1 << 19, 40)])
def test_hits_across_shards_and_pieces(monkeypatch, shard, chunk):
    from tidemark.llm import shingles

    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    monkeypatch.setattr(shingles, "CHUNK_BYTES", chunk)
    r = random.Random(shard)
    text = lambda n: " ".join(r.choice(["ab", "c", "é", "12", "dd", "e"]) for _ in range(n))
    bench = [(str(k), text(r.choice([2, 5, 10, 14]))) for k in range(10)]
    rows = [(k, text(r.randint(0, 60))) for k in range(12)] + [(50, text(30) + " " + bench[3][1] + " " + text(40) + " " + bench[3][1]), (51, None), (52, "x" * 200 + " " + bench[4][1])]
    n, spans, items = d.search_texts([t and t.encode() for _, t in rows], d.Windows([(k, t.encode()) for k, t in bench], 10), 10)
    got = [(i, n[k], sum(b - a + 1 for a, b in spans.get(k, ())), items.get(k, [])) for k, (i, _) in enumerate(rows)]
    assert sorted(got, key=repr) == brute(rows, bench)


def test_hits_of_many_blocks_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_HITS", 3)
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["ab", "c", "é", "12", "dd", "e"]) for _ in range(n))
    bench = [(k, text(r.choice([2, 5, 10, 14]))) for k in range(10)]
    rows = [(k, text(r.randint(0, 60))) for k in range(12)] + [(51, None), (5, text(9))]
    assert digest(d.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=200)) == brute(rows, bench)


def test_suffix_array_sorts_suffixes():
    r = np.random.default_rng(4)
    for _ in range(20):
        text = np.concatenate([np.append(r.integers(1, 3, r.integers(0, 30)), 0) for _ in range(5)] + [np.tile([1, 2], 20), [0]]).astype(np.int64)
        zeros = np.cumsum(text == 0) - 1 - (text == 0).sum()  # the zeros are apart, by place
        plain = sorted(range(len(text)), key=lambda i: [int(zeros[k]) if text[k] == 0 else int(text[k]) for k in range(i, len(text))])
        assert d.suffix_array(text).tolist() == plain


def test_a_block_of_windows_takes_little():
    items = [(str(k), b" ".join(b"w%d" % ((k * 7919 + i * i) % 50_000) for i in range(700))) for k in range(900)]
    began = time.process_time()
    w = d.Windows(items, 10)
    known = np.unique(w.hashes)
    sought, patterns = w.patterns(known)
    assert time.process_time() - began < 5 and len(sought) == 900 * 691
    assert w.hashes.nbytes + w.first.nbytes + w.item.nbytes + w.length.nbytes + patterns.nbytes < 64 << 20  # for 4 MB of items
