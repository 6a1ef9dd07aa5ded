"""Literal cases of planning, handles, owners and links."""

from pyspark.sql import functions as F

from tidemark.operators import planning as p, scoring as s


def test_patterns_are_ordered_by_what_was_useful(spark):
    tries = spark.createDataFrame([("x", "b {name}", True)] * 3 + [("x", "a {name}", False)] * 2 + [("x", "{name} c", True), ("x", "other", True)], "platform string, pattern string, useful boolean")
    shares = {r.pattern: r.share for r in p.learned(tries).collect()}
    assert shares["b {name}"] == 0.8 and shares["a {name}"] == 0.25 and abs(shares["{name} c"] - 2 / 3) < 1e-12
    schema = "entity_id long, name string, domain string, industry string, model string, tagline string, description string, accounts array<string>"
    entities = spark.createDataFrame([(1, "Acme", None, "ind", "b2b", "A Video tool", None, ["x"]), (2, "Bolt", "b.io", None, "b2b", None, None, None)], schema)
    evidence = spark.createDataFrame([(1, "x", 0.0), (1, "x", 0.0), (2, "x", 1.0)], "entity_id long, platform string, contribution double")
    out = {(r.entity_id, r.platform): r for r in p.plan(entities, {"x": ["a {name}", "new {domain}", "b {name}", "{name} c", "b {name}"], "instagram": ["{name}"]}, evidence, tries).collect()}
    assert set(out) == {(1, "x"), (1, "instagram"), (2, "instagram")}
    assert out[1, "x"].queries == ["b Acme", "Acme c", "new ", "a Acme"] and out[1, "x"].n_current == 2
    assert [out[k].priority for k in sorted(out)] == ["high", "high", "normal"]


def test_handles(spark):
    entities = spark.createDataFrame([(1, "Acme Robotics", "acme-robotics", "https://www.acmerobotics.com/x"), (2, "Bolt", "bolt", "https://bolt.io"), (3, "Robotics of Acme", "acmerobotics-3", "https://acme-robotics.com"), (4, "Lonely Planetary", "lonely", None)], "entity_id long, name string, slug string, website string")
    asked = [(1, "Acme.Robotics.com", "u1"), (1, "acme_robotics", "u2"), (2, "bolt.io", "u3"), (4, "lonelyplanetary", "u4"), (4, "lonelyplanetary", "u5"), (9, "who", "u6"), (4, None, "u7"), (2, "acmerobotics", "u8")]
    rejected = spark.createDataFrame([(4, "u5"), (1, "u3")], "entity_id long, url string")
    out = {r.url: r for r in p.handle_candidates(spark.createDataFrame(asked, "entity_id long, handle string, url string"), entities, rejected).collect()}
    assert len(out) == len(asked)
    assert out["u1"].exact_full_host and out["u1"].ambiguous and not out["u1"].verified  # the third's site has the same form
    assert out["u2"].exact_slug and out["u2"].exact_name and out["u2"].exact_host and not out["u2"].exact_full_host
    assert out["u3"].exact_full_host and out["u3"].ambiguous  # a short name
    assert out["u4"].exact_name and not out["u4"].ambiguous and out["u4"].review_state == "needs_review" and out["u5"].review_state == "rejected"
    assert out["u6"].ambiguous and not out["u7"].exact_name and out["u8"].ambiguous


def test_last_writer_owns_and_links_keep_their_place(spark):
    nodes = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (2, 1, ["b"]), (3, 2, None)], "entity_id long, ordinal int, evidence_ids array<string>")
    assert {(r.evidence_id, r.entity_id) for r in p.owners(nodes).collect()} == {("a", 1), ("b", 2)}
    assert {(r.id, r.entity_id) for r in p.owned(nodes, spark.createDataFrame([("b",), ("z",)], "id string")).collect()} == {("b", 2), ("z", None)}
    links = [("c", "x", f"u{k % 10}", k, f"n{k}") for k in range(13)] + [("c", "x", "https://x.com/share/", 0, "s"), ("c", None, "v", 20, "v"), ("c", "x", None, 0, "n")]
    got = p.social_candidates(spark.createDataFrame(links, "company string, platform string, url string, ordinal int, note string"), ["company"]).orderBy("place").collect()
    assert [(r.url, r.note) for r in got] == [("u0", "n10"), ("u1", "n11"), ("u2", "n12"), *[(f"u{k}", f"n{k}") for k in range(3, 8)]]
    url = lambda x: spark.range(1).select(p.search_target(F.lit(x)).alias("u")).first().u
    assert url("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc%3Fd&x=1") == "https://a.b/c" and url("//a.b/c?d#e") == "https://a.b/c" and url("no url?x") == "no url"


def test_top_platform(spark):
    rows = spark.createDataFrame([(1, "x", 1.0, 0), (1, "web", 9.0, 1), (2, "web", 3.0, 0), (2, "rss", 3.0, 1), (3, "x", 0.0, 0)], "entity_id long, platform string, score double, ordinal int")
    assert {(r.entity_id, r.platform) for r in s.top_platform(rows, {"x": 0.5}).collect()} == {(1, "x"), (2, "web"), (3, "x")}
