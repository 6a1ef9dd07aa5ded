import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    return luhn(d) and 16 <= len(d) <= 19 if kind == "card" else 8 <= len(d) <= 15 if kind == "phone" else True


def plain(t):
    return [(k, x.start(), x.end()) for k, p in PATTERNS.items() for x in re.finditer(p, t or "") if holds(k, x[0])]


def test_base_spans(spark):
    r = random.Random(4)
    parts = ["a@b.c", "@", ".", "x.y@z-1.co.uk", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "999", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+12", " ", "-", "é", "😀", "\n", "0", "12", "a", "%", "…", "+4915112345678", "00000000000000000"]
    texts = ["", None, "4" * 30_000, "a" * 30_000 + "@", "1 " * 8000, "x@" * 500] + ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for x in rows:
        assert [(s.kind, s.start, s.end) for s in x.s] == plain(x.text), x.text


def test_terms_that_reveal(spark):
    common = [(100 + k, "the weather of the day is fine and the road is dry") for k in range(40)]
    common = [(i, f"{t} w{i}") for i, t in common]
    told = [(k, f"the {w} Zorblax wrote to ann@example.org of the {w}\nnothing here") for k, w in enumerate(["day", "road", "weather", "sun"])]
    copies = [(50 + k, "one same line of quux to bob@example.org") for k in range(5)]
    docs = spark.createDataFrame([(i, t, "k", "s") for i, t in [*common, *told, *copies, (60, None), (61, "ask Zorblax")]], "doc_id long, text string, kept string, spans string").drop("spans")
    got = {x.doc_id: x.spans for x in pii.find_personal_data(docs).collect()}
    for i, t in told:
        kinds = [(s.kind, t[s.start : s.end].lower()) for s in got[i]]
        assert kinds[0] == ("email", "ann@example.org") and ("term", "zorblax") in kinds and ("term", "the") not in kinds
    assert all([s.kind for s in got[i]] == ["email"] for i, _ in copies)  # one text, however often
    assert got[60] == [] and got[61] == [] and all(got[i] == [] for i, _ in common)
    clean = pii.find_personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("spans")).alias("t")).collect()
    text = {x.doc_id: x.t for x in clean}
    assert "ann@" not in text[0] and "Zorblax" not in text[0] and "[EMAIL]" in text[0] and text[61] == "ask Zorblax" and text[60] is None


def test_terms_of_the_whole_text(spark):
    common = [(100 + k, f"the weather of the day is fine and the road is dry w{k}") for k in range(40)]
    far = "\n".join(["the day is dry"] * 30)
    told = [(k, f"Name: Zorblax\nMail: ann@example.org {w}\n{far}\nthe ZORBLAX, é😀 zorblax. Zorblaxian prezorblax") for k, w in enumerate(["day", "road", "weather", "sun"])]
    docs = spark.createDataFrame([*common, *told], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.find_personal_data(docs).collect()}
    for i, t in told:
        want = [(x.start(), x.end()) for x in re.finditer(r"\bzorblax\b", t, re.I)]
        assert len(want) == 3 and [(s.start, s.end) for s in got[i] if s.value == "zorblax"] == want
        assert not any(s.value in ("the", "day", "is", "dry") for s in got[i])
    assert all(got[i] == [] for i, _ in common)


def plain_terms(rows):
    """(entity, term) to the share of information, over distinct texts."""
    texts = {t or "" for t in rows}
    have, held = {}, {}
    for t in texts:
        spans = plain(t)
        entities = {k + ":" + (re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for k, a, b in spans}
        outside, at = "", 0
        for a, b in sorted((a, b) for _, a, b in spans):
            if a >= at:
                outside, at = outside + t[at:a] + " ", b
        outside += t[at:]
        word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        have[t] = {w.lower() for w in re.findall(word, t)}
        held[t] = (entities, {w.lower() for w in re.findall(word, outside)})
    n, out = len(texts), {}
    for c in {c for e, _ in held.values() for c in e}:
        n_c = sum(c in e for e, _ in held.values())
        for term in {w for e, ws in held.values() if c in e for w in ws} if n_c >= pii.SUPPORT else ():
            n_ct = sum(c in e and term in ws for e, ws in held.values())
            n_t = sum(term in ws for ws in have.values())
            share = math.log2(n * n_ct / (n_c * n_t)) / max(math.log2(n / n_c), 1e-9)
            if n_ct >= pii.SUPPORT and share >= pii.GENERALISE:
                out[c, term] = share
    return out


def test_shares_are_those_of_plain_counts(spark):
    r = random.Random(9)
    people = [(f"p{k}@mail.example", f"Name{k}", f"20{k}") for k in range(4)]
    texts = []
    for _ in range(160):
        words = [r.choice("the of and day road sun rain house tree".split()) for _ in range(r.randint(3, 12))]
        for mail, name, year in people:
            if r.random() < 0.08:
                words += [mail] * (r.random() < 0.8) + [name] * (r.random() < 0.8) + [year] * (r.random() < 0.6)
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:30] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.durable(pii._with_spans(docs), "found")
    of_entity = pii._held(found).select("entity", "seen").distinct().groupBy("entity").count().withColumnRenamed("count", "n_c").filter(F.col("n_c") >= pii.SUPPORT)
    got = {(x.entity, x.term): x.share for x in pii.revealing(pii.durable(pii._terms(found, of_entity), "near"), of_entity, docs).collect()}
    want = plain_terms(texts)
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_terms_are_generalised_to_their_class(spark):
    text = "Ann 1987 ab12 lower a@b.c gone"
    spans = [("term", 0, 3, "generalise"), ("term", 4, 8, "generalise"), ("term", 9, 13, "generalise"), ("term", 14, 19, "generalise"), ("email", 20, 25, "replace"), ("term", 26, 30, "remove")]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<kind:string,start:int,end:int,action:string>>")
    assert df.select(pii.sanitise(F.col("t"), F.col("s")).alias("x")).first().x == "[NAME] [NUMBER] [CODE] [WORD] [EMAIL] "


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.c", "s", 5, "k"), (1, "to a@b.c", "s", 5, "k")], "doc_id long, text string, spans string, row int, kept string")
    out = pii.find_personal_data(docs)
    assert out.columns == ["doc_id", "row", "kept", "spans"]
    assert [(x.row, x.kept, [s.kind for s in x.spans]) for x in out.collect()] == [(5, "k", ["email"])] * 2


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_many_matches_take_little_time(spark):
    import time

    text = "".join(f"a{k}@b{k % 97}.c, é Zed{k % 50}\n" for k in range(100_000))
    assert len(text.encode()) > 2_000_000
    want = plain(text)
    began = time.perf_counter()
    df = spark.createDataFrame([(text,)], "t string").select("t", pii.base_spans(F.col("t")).alias("s"))
    got = df.select(F.xxhash64("s"), "s", pii._replaced(F.col("t"), F.col("s"), lambda x: F.concat(F.lit("<"), x["written"], F.lit(">"))).alias("r")).first()
    assert time.perf_counter() - began < 30
    assert [(x.kind, x.start, x.end) for x in got.s] == want
    assert got.r == re.sub(PATTERNS["email"], lambda x: f"<{x[0]}>", text)


def test_replaced_and_clear_spans_are_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    monkeypatch.setattr(pii, "CHUNK", 5)
    r = random.Random(12)
    rows = []
    for _ in range(300):
        text = "".join(r.choice("abé\n😀 ") for _ in range(r.randint(0, 40)))
        cuts = [sorted((r.randint(0, len(text)), r.randint(0, len(text)))) for _ in range(r.randint(0, 9))]
        rows.append((text, [("email", a, b, "replace") for a, b in cuts if a < b], [("term", k, k + 2, f"v{k}", "remove") for k in range(0, 40, 3)]))
    span = "array<struct<kind:string,start:int,end:int,action:string>>"
    df = spark.createDataFrame(rows, f"t string, s {span}, w array<struct<kind:string,start:int,end:int,value:string,action:string>>")
    got = df.select("t", "s", "w", pii._replaced(F.col("t"), F.col("s"), lambda x: F.concat(F.lit("<"), x["written"], F.lit(">"))).alias("r"), pii._clear(F.col("w"), F.col("s")).alias("c")).collect()
    for x in got:
        out, at = "", 0
        for a, b, by in sorted((s.start, s.end, f"<{x.t[s.start : s.end]}>") for s in x.s):
            if a >= at:
                out, at = out + x.t[at:a] + by, b
        assert x.r == out + x.t[at:]
        assert [c.start for c in x.c] == [w.start for w in x.w if not any(s.start < w.end and w.start < s.end for s in x.s)]
