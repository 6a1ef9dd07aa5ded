"""Golden values and edge cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, match, num, text, urls
from tidemark.operators import attribution, config, dedupe, graph, media, ordering, params, ranking, reports, scoring, snapshots
from tidemark.plans import relations
from tidemark.sources import landed


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_and_guards(spark):
    assert one(spark, num.jround(F.lit(-0.5))) == 0 and one(spark, num.jround(F.lit(1.005), 2)) == 1.0 and one(spark, num.jround(F.lit(2.5))) == 3
    assert one(spark, num.clamp(F.lit(float("nan")), 1.0, 5.0)) == 1 and one(spark, num.clamp(F.lit(9.0), 1.0, 5.0)) == 5
    assert one(spark, num.safe(F.lit(float("inf")))) == 0 and one(spark, num.safe(F.lit(None).cast("double"))) == 0


def test_dates(spark):
    t = lambda x: dates.lenient(F.lit(x))
    assert one(spark, t("nonsense")) is None and one(spark, t("2026-06-01T00:00:00.000Z")) is not None
    assert one(spark, dates.decay(t("2026-06-01"), t("2026-07-01"), F.lit(30.0))) == 0.5
    assert one(spark, dates.decay(t("x"), t("2026-07-01"), F.lit(30.0))) == 0.75
    assert one(spark, dates.age_days(t("2026-07-02"), t("2026-07-01"))) == 0


def test_engagement_vectors(spark):
    live = lambda p, **m: one(spark, scoring.raw_engagement(F.lit(p), F.create_map(*[F.lit(x) for k in m.items() for x in (k[0], float(k[1]))])))
    assert live("instagram", views=100000, likes=100, comments=10) == 7660
    assert live("x", views=1000000, likes=1000, comments=100, reposts=100) == 82850
    assert live("linkedin", views=100000, reactions=100, comments=20, reposts=10) == 8340
    library = {"likes": 10.0, "comments": 2.0, "reposts": 1.0, "views": 100.0, "stars": 3.0, "forks": 1.0}
    m = F.create_map(*[F.lit(x) for k in library.items() for x in k])
    assert one(spark, scoring.weighted_sum(m, config.LIBRARY_METRICS)) == 30.5


def test_library_scores(spark):
    m = scoring.midrank(spark.createDataFrame([(v,) for v in (10.0, 20.0, 20.0, 40.0)], "v double"), [], "v", "p").filter("v = 20").first()
    assert m.p == 0.5
    posts = [("e", "x", float(s), k, "verified", 0.6) for k, s in enumerate((100, 90, 80, 70, 60, 0))]
    schema = "entity_id string, platform string, post_score double, ordinal int, review_state string, follower_percentile double"
    assert scoring.account_scores(spark.createDataFrame(posts, schema)).first().score == 81
    posts = [(*p[:4], "needs_review", p[5]) for p in posts]
    assert scoring.account_scores(spark.createDataFrame(posts, schema)).first().score == 0
    rows = [("c", "x", True, 80.0), ("c", "x", False, 40.0), ("c", "github", True, 60.0)]
    got = scoring.composite(spark.createDataFrame(rows, "entity_id string, platform string, official boolean, score double"), config.LIBRARY_PLATFORMS).first()
    assert abs(got.absolute - (64 * 0.25 + 60 * 0.2) / 0.45) < 0.01


def test_one_large_post_is_not_averaged_away(spark):
    rows = [("e", "x", float(s), k) for k, s in enumerate((100, 20, 15, 10, 10))]
    by = scoring.platform_scores(spark.createDataFrame(rows, "entity_id string, platform string, score double, ordinal int"))
    assert by.first().platform_score >= 80 and scoring.entity_scores(by).first().total >= 70
    full = spark.createDataFrame([("a", p, 1, 100.0) for p in config.LIVE.platform_weights] + [("b", "x", 1, 100.0)], "entity_id string, platform string, n int, platform_score double")
    assert {r.entity_id: r.total for r in scoring.entity_scores(full).collect()} == {"a": 100, "b": 91}


def test_urls(spark):
    cases = {
        "https://twitter.com/AllenX/status/12345?s=20&t=x": "https://x.com/allenx/status/12345",
        "https://mobile.twitter.com/allenx/status/12345#top": "https://x.com/allenx/status/12345",
        "https://www.instagram.com/reel/ABC123/?igshid=1": "https://instagram.com/reel/ABC123",
        "https://www.linkedin.com/posts/a-b/?trk=1": "https://linkedin.com/posts/a-b",
        "https://www.Example.com/a/?utm_source=x&b=2&ref=q": "https://example.com/a?b=2",
        "https://example.com": "https://example.com/",
        "https://example.com:8080/": "https://example.com:8080/",
        "https://example.com:443/a": "https://example.com/a",
        "not a url": "",
        "": "",
    }
    got = {r.u: r.c for r in spark.createDataFrame([(k,) for k in cases] + [(None,)], "u string").select("u", urls.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == cases | {None: ""}
    assert one(spark, urls.post_id(F.lit("youtube"), F.lit("https://youtube.com/watch?v=abc"))) == "abc"
    assert one(spark, urls.post_id(F.lit("x"), F.lit("https://x.com/a"))) is None
    assert one(spark, urls.handle(F.lit("linkedin"), F.lit("https://linkedin.com/in/Jane/"))) == "jane"
    assert one(spark, urls.platform_of(F.lit("https://www.youtube.com/x"))) == "youtube" and one(spark, urls.platform_of(F.lit("https://notx.com/"))) is None


def test_texts(spark):
    assert one(spark, text.slug(F.lit("--A b_C!"))) == "a-b-c"
    for t, n in (("1.2K", 1200), ("3M", 3_000_000), ("1,234", 1234), ("7", 7), ("x", None)):
        assert one(spark, text.compact_number(F.lit(t))) == n
    assert one(spark, text.compact_label(F.lit(1234.0))) == "1.2K" and one(spark, text.compact_label(F.lit(2_000_000.0))) == "2M"
    assert one(spark, text.redact(F.lit("key ghp_abcdefghijklmnop and token=abcdefghijklmnopqrst"))) == "key [redacted-public-token] and token=[redacted-public-param]"
    assert one(spark, text.readable_html(F.lit("<p>a&amp;b</p><script>x()</script> c"))) == "a&b c"
    assert one(spark, text.first_sentence(F.lit("One. Two."))) == "One."
    assert one(spark, attribution.classify(F.lit("An open source bank"))) == "open_source" and one(spark, attribution.classify(F.lit(""))) == "b2b"


def test_search_in_spite_of_errors(spark):
    labels = spark.createDataFrame([("1", "Luca Martin", "founder", 50.0), ("2", "PromptForge", "company", 60.0), ("3", "Lucid", "company", 10.0)], "id string, label string, kind string, score double")
    assert graph.search(labels, "Lukka Martn").first().label == "Luca Martin"
    assert graph.search(labels, "promptforge").first().match >= 100
    assert graph.search(labels, "zzzzqq").count() == 0
    assert one(spark, match.similarity(F.lit(""), F.lit(""))) == 1


def test_dedupe(spark):
    rows = [(k, "p", None, u, "acc", "an", "t") for k, u in enumerate(["https://x.com/a/status/1", "https://twitter.com/A/status/1?s=2", "bad", "bad"])]
    keyed = spark.createDataFrame(rows, "ordinal int, platform string, post string, url string, account string, author string, text string")
    keyed = keyed.withColumn("key", dedupe.evidence_key(*[F.col(c) for c in ("platform", "post", "url", "account", "author", "text")]))
    kept = dedupe.survivors(keyed, ["key"])
    assert sorted(r.ordinal for r in kept.collect()) == [0, 2]
    assert dedupe.survivors(kept, ["key"]).count() == 2
    h = spark.createDataFrame([("a", 1, "verified"), ("a", 2, "failed"), ("a", 3, "verified")], "k string, ordinal int, state string")
    r = dedupe.merge_states(h, ["k"]).first()
    assert (r.state, r.n_attempts, r.n_changes) == ("verified", 3, 2)


def greedy(edges, per_node, most):
    used, out = {}, []
    for w, a, b in sorted((-w, a, b) for a, b, w in edges):
        if len(out) < most and used.get(a, 0) < per_node and used.get(b, 0) < per_node:
            out.append((a, b, -w))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return sorted(out)


def test_greedy_edges_are_those_taken_one_by_one(spark):
    r = random.Random(1)
    edges = sorted({(a, b): (a, b, r.choice([0.3, 0.5, 0.5, 0.9])) for a, b in (sorted(r.sample(range(14), 2)) for _ in range(60))}.values())
    df = spark.createDataFrame(edges, "source long, target long, weight double")
    assert sorted(tuple(x) for x in graph.greedy_edges(df, 2, 9).collect()) == greedy(edges, 2, 9)
    assert graph.greedy_edges(df.limit(0)).count() == 0


def test_greedy_query_takes_edges_down_to_the_default_threshold(spark):
    sf_dir = "/root/testdata/sf0.001"
    edges = [tuple(x) for x in graph.similarity_edges(relations.items(spark, sf_dir)).collect()]
    got = sorted(tuple(x) for x in relations.greedy_degree_capped_edges(spark, sf_dir).collect())
    assert got == greedy(edges, 2, len(edges)) and 0.28 <= min(w for _, _, w in got) < 0.8


def test_filters_and_chains(spark):
    rows = spark.createDataFrame([("a", "A", "p", "i", "m", ["x"], 5.0), ("b", "B", "p", "i", "m", ["y"], 3.0), ("c", "C", None, "i", "m", [], 9.0)], "id string, label string, partner string, industry string, model string, platforms array<string>, score double")
    assert [(e.source, e.target) for e in graph.chain_edges(rows, "partner", F.desc("score"), "label").collect()] == [("a", "b")]
    pick = lambda **f: sorted(r.id for r in rows.filter(graph.matches(graph.Filters(**f))).collect())
    assert pick() == ["a", "b", "c"] and pick(partners=("p",)) == ["a", "b"] and pick(platforms=("y", "z")) == ["b"] and pick(min_score=4) == ["a", "c"] and pick(text="a") == ["a"]


def test_radius(spark):
    rows = spark.createDataFrame([(10.0,), (40.0,), (90.0,)], "s double")
    got = {r.s: r.radius for r in ranking.radius(rows, "s", 5, 68).collect()}
    assert got[10.0] == 5 and got[90.0] == 68
    assert ranking.radius(rows.filter("s = 10"), "s", 0, 10).first().radius == 10 * 0.5**2.2


def test_guard_rules(spark):
    flags = dict(platform="x", contribution=10.5, review_state="verified", resolved=True, verified_account=False, visible_signal=False, own_signal=False, context_only=False, quote=False, conflict=False, off_topic=False)
    cases = [
        ({"resolved": False}, "needs_review", "high", 0), ({"platform": "web"}, "verified", "low", 10.5), ({"platform": "web", "review_state": "rejected"}, "rejected", "low", 10.5), ({"platform": "github"}, "needs_review", "high", 0),
        ({"platform": "github", "own_signal": True}, "verified", "low", 10.5), ({"context_only": True}, "verified", "low", 0), ({"platform": "instagram", "visible_signal": True}, "needs_review", "high", 0), ({"conflict": True, "own_signal": True}, "needs_review", "high", 0),
        ({"quote": True, "own_signal": True}, "needs_review", "high", 0), ({"quote": True, "visible_signal": True}, "verified", "low", 10.5), ({"verified_account": True, "off_topic": True}, "needs_review", "medium", 0), ({"verified_account": True, "off_topic": True, "own_signal": True}, "needs_review", "medium", 0),
        ({"visible_signal": True, "conflict": True}, "verified", "low", 10.5), ({"verified_account": True}, "verified", "low", 10.5), ({"platform": "reddit"}, "needs_review", "high", 0), ({}, "needs_review", "medium", 0),
    ]
    for change, state, risk, guarded in cases:
        r = attribution.guard(spark.createDataFrame([flags | change])).first()
        assert (r.review_state, r.risk, r.guarded) == (state, risk, guarded), change


def test_snapshots(spark):
    rows = [("b", "daily", f"2026-06-{d:02d} 10:00:00", "e", float(d), 30 - d) for d in range(1, 21)]
    s = spark.createDataFrame(rows, "batch string, granularity string, t string, entity_id string, score double, rank int").withColumn("recorded_at", F.to_timestamp("t")).drop("t")
    now = F.lit("2026-06-20").cast("date")
    out = snapshots.momentum(snapshots.baseline(s, now, 0).select("entity_id", "score", "rank"), snapshots.baseline(s, now, 1), "day").first()
    assert (out.day_delta, out.day_ranks) == (1.0, 1)
    gap = snapshots.momentum(s.filter("score = 20").select("entity_id", "score", "rank"), snapshots.baseline(s, now, 40), "day").first()
    assert (gap.day_delta, gap.day_percent, gap.day_ranks) == (0, 0, 0)
    assert snapshots.retained(s, {"daily": 5, "weekly": 2}).count() == 5
    d = snapshots.due(s, F.lit("2026-06-20 12:00:00").cast("timestamp")).first()
    assert (d.daily_due, d.weekly_due) == (False, True)


def test_numbers_and_running_sums_by_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice("abc") if r.random() < 0.9 else None, r.randint(0, 40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(3)
    got = {x.k: x.n for x in ordering.numbered(df, "n", F.desc("v"), "k").collect()}
    assert got == {k: n + 1 for n, (_, _, k) in enumerate(sorted(rows, key=lambda x: (-x[1], x[2])))}
    counts = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    for x in ordering.running(counts, ["g"], "v", "c", "upto", "whole").collect():
        mine = [v for g, v, _ in rows if g == x.g]
        assert (x.upto, x.whole) == (sum(v <= x.v for v in mine), len(mine))
    assert ordering.numbered(df.limit(0), "n", "k").count() == 0
    p = {x.k: x.p for x in ranking.at_most_share(df, ["g"], "v", "p").collect()}
    assert all(abs(p[k] - sum(w <= v for h, w, _ in rows if h == g) / sum(h == g for h, _, _ in rows)) < 1e-12 for g, v, k in rows)


def test_tokens_and_jaccard(spark):
    assert one(spark, text.tokens(F.lit("The Company builds AI-tools for teams, tools"))) == ["tools"]
    assert one(spark, graph.jaccard(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a")))) == 0.5


def test_request_parameters():
    known = ["x", "github", "web"]
    assert params.parse_list("x, nope,github,", known) == ["x", "github"] and params.parse_list("a,,b ") == ["a", "b"] and params.parse_list(None) is None
    assert params.parse_number("1.5") == 1.5 and params.parse_number("x") is None and params.parse_number("inf") is None and params.parse_number("") is None
    assert params.distinct(["a", "", None, "b", "a"]) == ["a", "b"]
    assert params.resolve_batch("W1", ["W1", "S2026"]) == "W1" and params.resolve_batch("no", ["W1", "S2026"]) == "S2026" and params.resolve_batch("no", ["W1"]) == "W1" and params.resolve_batch("no", []) is None
    assert params.filters_of({"minScore": "40", "platforms": "x,bad", "q": "luca"}, known) == graph.Filters(40.0, platforms=("x",), text="luca")
    assert params.BatchRequest.of({"batchSlug": " S26 ", "options": {"demo": True, "maxCompanies": 5, "platforms": ["x"]}}, known) == params.BatchRequest("S26", {"demo": True}, 5, ("x",))
    for bad in ({"x": 1}, {"batchSlug": ""}, {"options": {"maxCompanies": 0}}, {"options": {"maxCompanies": True}}, {"options": {"platforms": ["no"]}}, {"options": {"demo": 1}}, {"options": {"sessionId": "a"}}, {"options": [{"apiKey": 1}]}):
        with pytest.raises(ValueError):
            params.BatchRequest.of(bad, known)


def test_attribution_of_given_cases(spark):
    schema = "entity_id string, name string, slug string, website string"
    entities = spark.createDataFrame([("alpha", "Alpha AI", "alpha-ai", "https://www.alpha.ai"), ("beta", "Beta Labs", "beta-labs", "https://beta.dev"), ("flow", "Flow", "flow", None)], schema)
    links = spark.createDataFrame([("alpha", "x", "https://x.com/alphaai", True), ("alpha", "x", "https://x.com/anaalpha", False), ("alpha", "instagram", "https://instagram.com/alpha.ai/", True), ("beta", "x", "https://twitter.com/betalabs", True)], "entity_id string, platform string, url string, own boolean")
    members = spark.createDataFrame([("alpha", "Ana Gomez")], "entity_id string, name string")
    signal = attribution.signals(entities, links, members)
    assert {r.value for r in signal.filter("entity_id = 'flow'").collect()} == set()
    base = dict(entity_id="alpha", platform="x", contribution=50.0, review_state="verified", text="", raw=None, author_name=None, author_handle="anaalpha", source_url="https://x.com/anaalpha/status/1", account_url="https://x.com/anaalpha", match_reason=None, why=None)
    cases = [
        ({"text": "new customer workflow video"}, "verified", "low"), ({"text": "Rented out a theater for a movie night with friends."}, "needs_review", "medium"), ({"text": "support tickets by guiding users"}, "verified", "low"),
        ({"text": "Beta Labs raised", "author_handle": "someone", "source_url": "https://x.com/someone/status/2", "account_url": None}, "needs_review", "high"), ({"text": "Alpha AI and Beta Labs"}, "verified", "low"), ({"text": "thanks @betalabs!"}, "needs_review", "high"),
        ({"text": "see https://docs.beta.dev/a"}, "needs_review", "high"), ({"entity_id": "nobody"}, "needs_review", "high"), ({"text": "x", "raw": '{"is_retweet": true}'}, "verified", "low"), ({"text": "hello", "platform": "instagram"}, "needs_review", "high"),
        ({"text": "hello", "platform": "instagram", "raw": '{"profile": {"url": "https://www.instagram.com/alpha.ai/"}}'}, "verified", "low"), ({"text": "about Ana Gomez", "platform": "youtube", "author_handle": None, "source_url": "https://youtu.be/1", "account_url": None}, "verified", "low"),
        ({"text": "Quote of it", "author_handle": None, "source_url": "https://x.com/who/status/1", "account_url": None}, "needs_review", "high"), ({"text": "fun", "platform": "reddit", "author_handle": None, "source_url": "https://blog.alpha.ai/p", "account_url": None}, "verified", "low"),
    ]
    rows = [base | change | {"id": k} for k, (change, _, _) in enumerate(cases)]
    types = "id long, entity_id string, platform string, contribution double, review_state string, text string, raw string, author_name string, author_handle string, source_url string, account_url string, match_reason string, why string"
    got = {r.id: (r.review_state, r.risk) for r in attribution.guard(attribution.evidence_flags(spark.createDataFrame(rows, types), signal, entities)).collect()}
    for k, (change, state, risk) in enumerate(cases):
        assert got[k] == (state, risk), change


def test_small_functions(spark):
    assert one(spark, text.batch_slug(F.lit("YC Spring 2026"))) == "S2026" and one(spark, text.batch_slug(F.lit("w 2025"))) == "W2025" and one(spark, text.batch_label(F.lit("winter 2025"))) == "Winter 2025"
    now = F.lit("2026-06-20 12:00:00").cast("timestamp")
    assert str(one(spark, dates.spoken(F.lit("5h ago"), now))) == "2026-06-20 07:00:00" and str(one(spark, dates.spoken(F.lit("Jun 3"), now))) == "2026-06-03 00:00:00" and one(spark, dates.spoken(F.lit("soon"), now)) is None
    assert one(spark, urls.site_handle(F.lit("https://www.linkedin.com/in/Jane-Doe/"))) == "jane-doe" and one(spark, urls.site_handle(F.lit("no url"))) == "" and one(spark, urls.own_handle(F.lit("@A.b-"))) == "a.b"
    picture = lambda platform, stored, many, raw, url: one(spark, media.resolve(F.lit(platform), F.lit(stored), F.array(*map(F.lit, many)).cast("array<string>"), F.lit(raw), F.lit(url)))
    assert picture("youtube", None, [], None, "https://youtu.be/abc-1").picture == "https://i.ytimg.com/vi/abc-1/hqdefault.jpg"
    assert picture("x", None, ["https://a.com/1.png", "https://pbs.twimg.com/media/2?format=jpg"], None, None).picture == "https://pbs.twimg.com/media/2?format=jpg"
    assert picture("x", None, [], "![x](https://a.com/favicon.png)", None) == (None, None)


def test_library_company_score(spark):
    rows = [("c", "x", 64.0, "verified"), ("c", "github", 60.0, "verified"), ("c", "youtube", 90.0, "needs_review"), ("d", "x", 20.0, "rejected"), ("e", "x", 100.0, "verified")]
    got = {r.entity_id: r for r in scoring.composite_total(spark.createDataFrame(rows, "entity_id string, platform string, score double, state string")).collect()}
    assert (got["c"].absolute, got["c"].review_state) == (58.28, "verified") and got["d"].absolute == 0 and got["d"].review_state == "rejected"
    assert abs(got["c"].coverage - 0.45) < 1e-9 and got["c"].total == 50.0


def test_reports_and_sources(spark):
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, n long").coalesce(1)
    assert reports.markdown(rows, "T") == "## T\n\n| x | n |\n| --- | --- |\n| a/b | 1 |\n|  | 2 |\n"
    got, warnings = landed.first_filled([("official", rows.limit(0)), ("fallback", rows)], 3)
    assert got.count() == 2 and warnings == ["official: no rows", "fallback: 2 rows, expected 3"]
    assert one(spark, text.stable_id(F.lit("A b" * 100)))[:7] == "a-ba-ba" and len(one(spark, text.stable_id(F.lit("A b" * 100)))) == 180


def test_midranks_of_foreign_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    pop = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", nan), ("a", inf), ("a", None), (None, 5.0), ("b", nan)], "g string, v double")
    probes = spark.createDataFrame([("a", 2.0), ("a", 1.5), ("a", 9.0), ("a", 0.0), ("a", nan), ("a", -inf), ("a", None), (None, 5.0), ("b", 1.0), ("c", 1.0)], "g string, v double")
    got = [(x.g, str(x.v), round(x.p, 6)) for x in scoring.midranks(probes, ["g"], {"v": "p"}, pop).collect()]
    want = [("a", "2.0", 0.666667), ("a", "1.5", 0.333333), ("a", "9.0", 1.0), ("a", "0.0", 0.0), ("a", "nan", 0.0), ("a", "-inf", 0.0), ("a", "None", 0.5), (None, "5.0", 0.5), ("b", "1.0", 0.5), ("c", "1.0", 0.5)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    two = scoring.midranks(pop.withColumn("w", -F.col("v")), ["g"], {"v": "p", "w": "q"}).filter("g = 'a' AND v = 2").first()
    assert round(two.p, 6) == 0.666667 and round(two.q, 6) == 0.333333
    assert scoring.midranks(pop.limit(0), ["g"], {"v": "p"}).count() == 0
