"""Evidence and texts meet entities by their rarest keys: nothing is lost, and few pairs are looked at in vain."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import attribution as a
from tidemark.plans import catalogue


def plain(t):
    t = re.sub(r"https?://(www\.)?", " ", (t or "").lower())
    return re.sub(r"[^a-z0-9.]+", " ", re.sub("[_-]+", " ", t)).strip(" ")


def has(t, p):
    return p in t and re.search(r"(^|[^a-z0-9])" + p.replace(".", r"\.") + r"([^a-z0-9]|$)", t) is not None


def test_phrases_are_those_of_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(a, "SPREAD", 5)
    r = random.Random(5)
    words = ["red", "blue", "red blue", "v1.2", "st.", "x", "Red-Blue", "www", "a b c", "é", "blue.", "..", "7"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(200)] + [(900, None), (901, "")]
    phrases = [(j, r.choice(["", ".", "-"]) + " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for j in range(60)] + [(99, None), (100, "--")]
    got = a.phrase_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "phrase_id long, phrase string"), "doc_id", "text").collect()
    want = {(i, j) for i, t in texts for j, p in phrases if re.search("[a-z0-9]", plain(p)) and has(plain(t), plain(p))}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 200


def test_conflicts_are_those_of_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(a, "SPREAD", 4)
    monkeypatch.setattr(a, "BROADCAST_KEYS", 3)
    r = random.Random(6)
    sites = [f"{r.choice(['app', 'go', 'alpha'])}{r.choice(['', '.alpha', '.beta'])}.{r.choice(['io', 'co.uk', 'dev'])}" for _ in range(12)]
    names = ["alpha works", "alpha works 2", "beta works", "alphaworks", "zeta"]
    signal = [(r.randint(1, 6), "name", None, n) for n in names * 2] + [(r.randint(1, 6), "domain", None, s) for s in sites] + [(r.randint(1, 6), "handle", "x", h) for h in ("alpha_1", "abc", "zeta.io")]
    parts = [*names, *sites, "my", "@alpha_1,", "@alpha_12", "https://x.com/zeta.io?a", "xalpha.io.", "alpha.iox", "@abc", "works", "."]
    evidence = [(i, r.randint(1, 6), " ".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(300)] + [(999, 1, None)]
    signals = spark.createDataFrame(sorted(set(signal), key=repr), "entity_id long, kind string, platform string, value string")
    got = a.conflicts(spark.createDataFrame(evidence, "id long, entity_id long, visible string"), signals).collect()
    want = set()
    for i, own, text in evidence:
        t, low = plain(text), (text or "").lower()
        for other, kind, _, v in set(signal):
            shown = has(t, v) if kind == "name" else v in t if kind == "domain" else len(v) >= 4 and (
                re.search(rf"(?:^|[^a-z0-9])@{re.escape(v)}(?:[^a-z0-9]|$)", low) or re.search(rf"(?:x|twitter|instagram|linkedin|github)\.com/{re.escape(v)}(?:[/\"'\s?#]|$)", low)
            )
            if shown and own != other:
                want.add((i, other))
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100


def test_pairs_stay_near_what_holds(spark):
    """Names that share their words, sites that share their beginning: pairs that are looked at against those that hold."""
    n = 400
    s = spark.range(n).select(F.col("id").alias("entity_id"), F.col("id").cast("string").alias("k"))
    row = lambda kind, value: s.select("entity_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("platform"), value.alias("value"))
    signals = row("name", F.concat(F.lit("alpha works "), "k")).unionByName(row("domain", F.concat(F.lit("alpha"), "k", F.lit(".io"))))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("News of Alpha Works "), (F.col("id") % n).cast("string"))).otherwise(F.concat(F.lit("see https://www.alpha"), (F.col("id") % n).cast("string"), F.lit(".io/x")))
    posts = spark.range(5000).select("id", F.lit(-1).cast("long").alias("entity_id"), text.alias("visible"))
    pairs, held = a.conflict_pairs(posts, signals).count(), a.conflicts(posts, signals).count()
    assert held == 5000 and pairs <= 2 * held


def test_signals_are_taken_once(spark):
    """What names entities is worked out once, however often evidence meets it."""
    taken = spark.sparkContext.accumulator(0)

    def seen(name):
        taken.add(1)
        return name

    n = 50
    k = F.col("id").cast("string")
    name = F.udf(seen, "string").asNondeterministic()(F.concat(F.lit("Alpha Works "), k))
    entities = spark.range(n).select(F.col("id").alias("entity_id"), F.concat(F.lit("alpha-works-"), k).alias("slug"), F.concat(F.lit("https://alpha"), k, F.lit(".io")).alias("website"), name.alias("name"))
    links = spark.range(n).select(F.col("id").alias("entity_id"), F.lit("x").alias("platform"), F.concat(F.lit("https://x.com/alpha_"), k).alias("url"), F.lit(False).alias("own"))
    members = spark.range(n).select(F.col("id").alias("entity_id"), F.concat(F.lit("Ann Person"), k).alias("name"))
    none = F.lit(None).cast("string")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Alpha Works "), (F.col("id") % n).cast("string"))).otherwise(F.concat(F.lit("hi @alpha_"), (F.col("id") % n).cast("string")))
    posts = spark.range(400).select("id", (F.col("id") % 7).alias("entity_id"), F.lit("x").alias("platform"), F.lit(1.0).alias("contribution"), text.alias("text"), *[none.alias(c) for c in ("review_state", "raw", "author_name", "author_handle", "source_url", "account_url", "match_reason", "why")])
    got = a.evidence_flags(posts, a.signals(entities, links, members), entities).collect()
    assert taken.value == n and len(got) == 400
    assert all(r.conflict == (r.id % n != r.id % 7) and r.visible_signal == (r.id % 2 == 0 and r.id % n == r.id % 7) for r in got)


def test_verdicts_are_those_of_the_guard(spark):
    r = random.Random(8)
    entities = spark.createDataFrame([(k, f"Alpha Works {k}", f"alpha-works-{k}", f"https://alpha{k}.io") for k in range(6)], "entity_id long, name string, slug string, website string")
    links = spark.createDataFrame([(k, p, f"https://{p}.com/alpha_{k}", True) for k in range(6) for p in ("x", "instagram")], "entity_id long, platform string, url string, own boolean")
    members = spark.createDataFrame([(k, f"Ann Person{k}") for k in range(6)], "entity_id long, name string")
    texts = [*[f"{t}{k}{e}" for k in range(3) for t, e in (("Alpha Works ", ""), ("see https://alpha", ".io/n"), ("hi @alpha_", "!"))], "movie", "quote", "", None]
    some = lambda *xs: r.choice(xs)
    rows = [
        (k, some(0, 1, 2, 9, None), some("x", "instagram", "github", "reddit", "web", "blog", None), some(0.0, -2.5, 7.5, None), some(None, "rejected", "verified"), f"{some(*texts)} {some(*texts)}" if k % 9 else None, some(None, '{"caption": "Alpha Works 2"}', '{"is_retweet": true}'), None, some("@Alpha_1", "alpha_2", None),
         some("https://x.com/who/status/1", "https://alpha1.io/a", None), None, None, some(None, "context only"))
        for k in range(900)
    ]
    evidence = spark.createDataFrame(rows, "id long, entity_id long, platform string, contribution double, review_state string, text string, raw string, author_name string, author_handle string, source_url string, account_url string, match_reason string, why string")
    signal, columns = a.signals(entities, links, members), ["id", "platform", "contribution", "review_state", "multiplier", "risk", "guarded"]
    flags = a.evidence_flags(evidence, signal, entities)
    got, want = a.verdicts(evidence, signal, entities), a.guard(flags).select(columns)
    assert got.columns == columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    states = lambda df: {r.id: (r.review_state, r.risk, r.guarded) for r in a.guard(df).collect()}
    torn, clear = states(flags), states(flags.withColumn("conflict", F.lit(False)))
    assert 20 < sum(torn[k] != clear[k] for k in torn) < 450


def test_conflicts_are_sought_where_they_decide(spark, monkeypatch):
    """Of the posts to be judged, those whose verdict no conflict can change meet no other entity."""
    asked, conflicts = [], a.conflicts

    def seen(evidence, signal):
        asked.append(evidence.count())
        return conflicts(evidence, signal)

    monkeypatch.setattr(a, "conflicts", seen)
    sf_dir = "/root/testdata/sf0.001"
    posts = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for query in ("risk_counts", "attribution_audit"):
        asked.clear()
        catalogue.QUERIES[query](spark, sf_dir).collect()
        assert len(asked) == 1 and 0 < asked[0] < posts / 5
