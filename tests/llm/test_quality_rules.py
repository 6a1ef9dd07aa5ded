import random
import re
from collections import Counter

from tidemark.llm import quality_rules as q
from tidemark.llm.tables import table


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_features_are_those_of_plain_code(spark):
    r = random.Random(2)
    texts = ["", None, "a", "a b", "a b c", "x x x x", "é\n\né\n é\n#*$%&|<>", "a b c a b c\na b c a b c", " \t\x0b\x0c\r\n "]
    texts += ["".join(r.choice(["a ", "b ", "cé ", "\n", "# ", "x\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["w w " * 9000]
    rows = q.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r_ in rows:
        assert (r_.n_words, r_.word_chars, r_.n_symbols, r_.n_dup_lines, r_.n_repeat_words) == plain(r_.text), r_.text


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op2_quality_rules(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("quality", "label"), "doc_id").filter("NOT base_failed").collect()
    right = sum(r.kept == (r.label == 1) for r in got)
    assert right >= 0.97 * len(got)
    assert all(r.kept for r in got if r.label == 1)


def test_filter_keeps_columns_and_takes_odd_tables(spark):
    good = " ".join(f"the word{k} of{k} day{k}" for k in range(60)) + "."
    docs = spark.createDataFrame([(1, good, "x"), (2, None, "y"), (None, good, "z"), (1, good, "x"), (3, "# " * 80, "s")], "doc_id long, text string, n_words string")
    out = q.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.filter("text LIKE 'the%'").collect()))
    assert q.keep_good(docs.limit(0)).count() == 0


def plain_fit(patterns, names):
    """Expectation-maximisation in plain code, to the end."""
    share = {k: dict(q.PRIOR_VOTES) for k in names}
    prior, moved = q.PRIOR_GOOD, 1.0
    while moved >= q.TOLERANCE:
        n, n_good, votes = 0, 0.0, {(k, y, v): 0.0 for k in names for y in (True, False) for v in (-1, 0, 1)}
        for row, count in patterns:
            p = {y: (prior if y else 1 - prior) for y in (True, False)}
            for k, v in zip(names, row, strict=True):
                for y in p:
                    p[y] *= share[k][y][v + 1]
            good = p[True] / (p[True] + p[False])
            n, n_good = n + count, n_good + count * good
            for k, v in zip(names, row, strict=True):
                votes[k, True, v] += count * good
                votes[k, False, v] += count * (1 - good)
        of = {True: n_good, False: n - n_good}
        w = q.PRIOR_WEIGHT
        new = {k: {y: tuple((votes[k, y, v] + w * q.PRIOR_VOTES[y][v + 1]) / (of[y] + w) for v in (-1, 0, 1)) for y in (True, False)} for k in names}
        new_prior = (n_good + w * q.PRIOR_GOOD) / (n + w)
        moved = max([abs(new_prior - prior), *(abs(a - b) for k in names for y in (True, False) for a, b in zip(new[k][y], share[k][y], strict=True))])
        share, prior = new, new_prior
    return share, prior


def test_estimates_are_those_of_plain_code(spark):
    r = random.Random(7)
    names = ["a", "b", "c"]
    rows = Counter()
    for _ in range(3000):
        good = r.random() < 0.7
        rows[tuple(r.choices((-1, 0, 1), (0.1, 0.2, 0.7) if good else (0.6, 0.3, 0.1))[0] for _ in names)] += 1
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], "a int, b int, c int, n long")
    accuracy, prior = q.fit(df, names)
    want, want_prior = plain_fit(list(rows.items()), names)
    assert abs(prior - want_prior) < 1e-9
    for k, got in zip(names, accuracy, strict=True):
        assert all(abs(x - y) < 1e-9 for s in (True, False) for x, y in zip(got[s], want[k][s], strict=True))
    assert q.fit(df.limit(0), names) == ([dict(q.PRIOR_VOTES)] * 3, q.PRIOR_GOOD)


def test_verdicts_follow_the_plain_posterior(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    scored = q.features(docs)
    votes = scored.select("doc_id", *[v.alias(k) for k, v in q.rules().items()]).collect()
    names = list(q.rules())
    share, prior = plain_fit(list(Counter(tuple(v[k] for k in names) for v in votes).items()), names)
    good = {}
    for v in votes:
        p = {True: prior, False: 1 - prior}
        for k in names:
            for y in p:
                p[y] *= share[k][y][v[k] + 1]
        good[v.doc_id] = p[True] / (p[True] + p[False])
    for x in q.op2_quality_rules(spark, "/root/testdata/sf0.001").collect():
        assert abs(x.quality - good[x.doc_id]) < 1e-6
        assert x.kept == (good[x.doc_id] >= 0.5 and not x.base_failed)
