import random

import pytest

from tidemark.llm import mixing as m


def level(sizes):
    """Targets by sharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in open_)
        goal = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if goal[s] > 2 * sizes[s]]
        if not over:
            return goal | full
        full |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {r.choice(["é", "Z", "a", "b", "aa", "\U0001f600", "￿", "z"]) + str(k % 7): r.choice([0, 1, 7, 100, 5000]) for k in range(r.randint(1, 14))} | {None: 50}
    got = {r_.source: r_.target for r_ in m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = level(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_knapsack_is_best():
    r = random.Random(1)
    for _ in range(200):
        free = [(n, r.randint(1, 4)) for n in r.sample(range(1, 30), r.randint(1, 5))]
        budget = r.randint(1, 120)
        sums = {0}
        for n, c in free:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = m.knapsack(free, budget)
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= budget)
        assert all(got.get(n, 0) <= c for n, c in free) and set(got) <= {n for n, _ in free}


def test_counts_meet_large_budgets():
    r = random.Random(2)
    for _ in range(20):
        counts = {n: r.randint(1, 300) for n in r.sample(range(1, 4000), 400)}
        rest = r.randrange(sum(n * c for n, c in counts.items()))
        got = m.choose_counts(counts, rest)
        assert sum(n * c for n, c in got.items()) == rest
        assert all(0 < c <= counts[n] for n, c in got.items())


def nearest(counts, rest):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= rest}
    return max(sums)


def test_counts_are_best_above_reach():
    assert m.choose_counts({100002: 1, 100000: 1}, 100001) == {100000: 1}
    assert m.choose_counts({120000: 1, 115000: 1, 105000: 1, 100000: 1}, 220000) in ({120000: 1, 100000: 1}, {115000: 1, 105000: 1})
    r = random.Random(5)
    for _ in range(60):
        counts = {n: r.randint(1, 3) for n in r.sample(range(20_000, 300_000), r.randint(1, 6))}
        rest = r.randrange(1, sum(n * c for n, c in counts.items()))
        got = m.choose_counts(counts, rest)
        assert sum(n * c for n, c in got.items()) == nearest(counts, rest), (counts, rest)
        assert all(0 < c <= counts[n] for n, c in got.items())


def test_counts_are_best_with_little_reach(monkeypatch):
    monkeypatch.setattr(m, "REACH", 16)
    r = random.Random(6)
    for _ in range(300):
        counts = {n: r.choice([1, 2, 60]) for n in r.sample(range(2, 30), r.randint(1, 4))}
        rest = r.randrange(1, sum(n * c for n, c in counts.items()))
        got = m.choose_counts(counts, rest)
        assert sum(n * c for n, c in got.items()) == nearest(counts, rest), (counts, rest)
        assert all(0 < c <= counts[n] for n, c in got.items())


def test_counts_that_no_subset_can_meet():
    """Long documents of one divisor and few short ones: the best is below `rest`, and known without all the sums between."""
    import time
    import tracemalloc

    for per, most in ((1_000_000, 200), (20_000, 60)):
        counts = {512 * k: per for k in range(1, most + 1)} | {1: 3}
        rest = (512 * per * most * (most + 1) // 2) // 1024 * 512 + 300
        tracemalloc.start()
        began = time.process_time()
        got = m.choose_counts(counts, rest)
        assert time.process_time() - began < 5 and tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        assert sum(n * c for n, c in got.items()) == rest - 297
        assert all(0 < c <= counts[n] for n, c in got.items())


def test_residues_bound_and_meet():
    r = random.Random(7)
    met = 0
    for _ in range(400):
        counts = {n: r.choice([1, 2, 9]) for n in r.sample(range(2, 40), r.randint(2, 4))}
        rest = r.randrange(1, sum(n * c for n, c in counts.items()))
        start = m._greedy(counts, rest)
        for by in counts:
            most, moved = m._moved(counts, start, rest - m._words(start), by)
            assert m._words(start) + most >= nearest(counts, rest)
            if moved:
                met += 1
                assert m._words(moved) == m._words(start) + most == nearest(counts, rest)
                assert all(0 <= c <= counts[n] for n, c in moved.items())
    assert met > 100


def test_mix(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", None])) for k in range(600)] + [(1000, None, "a"), (1001, "", "d"), (5, "x y", "a"), (5, "x y", "a")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, times int")
    got = m.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert x.taken in (0, x["size"], 2 * x["size"])
        by.setdefault(x.source, []).append(x)
    for xs in by.values():
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= 1 and xs[0].source_size == sum(x["size"] for x in xs)
    assert sorted(map(repr, got)) == sorted(map(repr, m.mix_sizes(docs.repartition(3)).collect()))
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((x.text or "").split()) for x in mixed.collect()) == sum(x.taken for x in got)
    assert m.mix_sizes(docs.limit(0)).count() == 0


def test_ranking_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "RANKED", 16)
    docs = spark.createDataFrame([(k, "a b c", "x" if k % 3 else "y") for k in range(900)], "doc_id long, text string, source string")
    got = m.mix_sizes(docs).collect()
    for s in ("x", "y"):
        xs = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= 3
