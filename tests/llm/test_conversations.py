import random

from tidemark.llm import conversations as c

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for i, turn, role, text in rows:
        if i is not None:
            convs.setdefault(i, []).append((turn, role, text))
    for role, text in {(x[2], x[3]) for x in rows if x[0] is None}:
        convs[None, role, text] = [(0, role, text)]
    none_first = lambda x: (x is not None, x or "")
    seqs = {i: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, none_first(y[1]), none_first(y[2])))] for i, x in convs.items()}
    order = lambda i: (isinstance(i, tuple), 0 if isinstance(i, tuple) else i)
    kept = [i for i, s in seqs.items() if not any(j != i and o[: len(s)] == s and (len(o) > len(s) or order(j) < order(i)) for j, o in seqs.items())]
    return sorted(((None if isinstance(i, tuple) else i, len(seqs[i]), "\n".join(f"<|{r or ''}|>\n{t or ''}<|end|>" for r, t in seqs[i])) for i in kept), key=repr)


def test_maximal_conversations(spark):
    r = random.Random(1)
    rows = []
    for i in range(80):
        base = r.randint(0, 6)
        for turn in range(r.randint(1, 6)):
            rows.append((i, turn * 2, r.choice(["user", "assistant"]) if r.random() < 0.05 else ("user", "assistant")[turn % 2], f"{base}-{turn}" if r.random() < 0.95 else r.choice([None, ""])))
    rows += [(None, 1, "user", "0-0"), (None, 2, None, None), (None, 7, None, None), (None, 1, "user", "alone"), (None, None, "user", "alone"), (None, 3, "user", "a"), (None, 3, "user", "b"), (500, 1, None, "x"), (501, 1, "", "x"), (502, 1, "user", None), (503, 1, "user", ""), (504, None, "user", "x" * 50_000), (505, 1, "user", "a"), (505, 1, "user", "a"), (506, 1, "user", "a")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], TURNS + ", place int, fp1 int")
    assert sorted(map(tuple, c.collapse(docs.repartition(3)).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert c.collapse(spark.createDataFrame([], TURNS)).count() == 0


def test_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(None, 1, "user", "a"), (None, 2, "user", "a"), (None, 1, None, "x"), (1, 1, "user", "a"), (1, 2, "user", "b"), (2, 1, "user", "c"), (3, 1, "user", "c"), (None, 1, "user", "c"), (None, 1, "user", "d"), (4, 1, None, None), (4, 2, "", "")]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(c.SQL).fetchall(), key=repr) == sorted(map(tuple, c.op9_chat_format(spark, str(tmp_path)).collect()), key=repr) == brute(rows)
