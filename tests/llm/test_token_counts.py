import random

from tidemark.llm import token_counts as t


def greedy(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_counts_are_those_of_greedy_matching():
    r = random.Random(1)
    for _ in range(300):
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))}
        a = t.Automaton(pieces)
        for _ in range(40):
            word = "".join(r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 12)))
            assert a.count(word) == greedy(word, pieces), (word, pieces)


def test_whole_texts(spark):
    import public_tokenizers

    pieces = t.read_pieces(public_tokenizers.path(t.VOCABULARY))
    known = set(pieces)
    rows = [(1, "The quick brownest fox"), (2, None), (3, " \n"), (None, "\U0001f9ff"), (5, "unbelievably " * 20_000), (1, "The")]
    got = t.count_tokens(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_words int"), pieces).collect()
    want = [(i, len((x or "").split()), sum(greedy(t.OPEN + w, known) for w in (x or "").split()[:200]) * (100 if i == 5 else 1)) for i, x in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string"), pieces).count() == 0
