"""Queries over pictures, identity out of texts, and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as a, media as m
from tidemark.plans.adapters import read
from tidemark.plans.evidence import by, joined
from tidemark.plans.registry import registry
from tidemark.sources import landed

QUERIES, ORACLE, query = registry()


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://s.com/' || event_id || '.png' WHEN 1 THEN 'https://i.ytimg.com/vi/v' || event_id || '/hqdefault.jpg' WHEN 2 THEN 'https://pbs.twimg.com/media/' || event_id || '?format=jpg' WHEN 3 THEN 'https://m.com/a.webp' WHEN 4 THEN 'https://j.com/c.jpg' END AS picture,
  CASE event_id % 6 WHEN 0 THEN 'stored' WHEN 1 THEN 'video' WHEN 5 THEN NULL ELSE 'media' END AS origin FROM events""")
def evidence_pictures(spark, sf_dir):
    i = F.col("event_id")
    stored = F.when(i % 6 == 0, joined("https://s.com/", i, ".png),"))
    urls = F.when(i % 6 == 2, F.array(F.lit("https://a.com/logo.png"), F.lit("https://a.com/b.png"), joined("https://pbs.twimg.com/media/", i, "?format=jpg")))
    raw = F.when(i % 6 == 3, "look ![a](https://m.com/a.webp) here").when(i % 6 == 4, '{"profile": 1, "cover_image": "https:\\/\\/j.com\\/c.jpg"}').when(i % 6 == 5, "https://a.com/avatar.png")
    got = m.resolve(F.when(i % 6 == 1, "youtube").otherwise("x"), stored, urls, raw, joined("https://www.youtube.com/watch?v=v", i))
    return read(spark, sf_dir, "events").select("event_id", got.alias("g")).select("event_id", "g.picture", "g.origin")


@query("""WITH e AS (SELECT user_id % 40 AS entity_id, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS score, event_id % 4 <> 0 AS pic FROM events WHERE event_type = 'view'), r AS (SELECT entity_id, count(*) AS n_rows, count(*) FILTER (score > 0) AS n_scored, count(*) FILTER (pic) AS n_pictures, arg_max('u' || event_id, {'s': score, 'u': 'u' || event_id}) AS top_url FROM e GROUP BY 1
), t AS (SELECT c_custkey AS entity_id, c_custkey % 5 AS k FROM customer)
SELECT t.entity_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_scored, 0) AS n_scored, coalesce(n_pictures, 0) AS n_pictures, top_url, CASE WHEN coalesce(n_scored, 0) > 0 THEN NULL WHEN k = 0 THEN 'no_scored_post' WHEN k = 1 THEN 'candidate_in_review' WHEN k = 2 THEN 'discovery_failed' WHEN k = 3 THEN 'nothing_found' ELSE 'no_target' END AS reason FROM t LEFT JOIN r USING (entity_id)""")
def picture_accounts(spark, sf_dir):
    c, e, i = read(spark, sf_dir, "customer"), read(spark, sf_dir, "events"), F.col("event_id")
    entities = c.select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 5).alias("k"))
    evidence = e.filter("event_type = 'view'").select((F.col("user_id") % 40).alias("entity_id"), F.when(i % 3 == 0, 0.0).otherwise(F.col("value")).alias("score"), joined("u", i).alias("url"), F.when(i % 4 != 0, "p").alias("picture"))
    attempts = entities.select("entity_id", F.when(F.col("k") == 1, "needs_review").when(F.col("k") == 2, "failed").when(F.col("k") == 3, "no_results").alias("status"))
    return m.account_coverage(entities, evidence, entities.filter("k = 0"), attempts)


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'company' ELSE 'founder' END AS kind, c_custkey % 7 AS k, c_custkey % 5 AS w FROM customer
), s AS (SELECT *, k IN (0, 1, 2) AS same, w = 0 AS domain, k IN (1, 3) AS bio, k IN (1, 4) AS program, kind = 'founder' AND k IN (1, 5) AS role, k IN (1, 4) AS batch, k = 6 AS site, w = 1 AS recent FROM r)
SELECT id, site::INTEGER + same::INTEGER + domain::INTEGER + bio::INTEGER + program::INTEGER + role::INTEGER + batch::INTEGER + recent::INTEGER AS n_matches,
  CASE WHEN site OR (kind = 'company' AND same AND domain) OR (kind = 'founder' AND same AND role AND (bio OR domain)) OR (kind = 'founder' AND same AND program AND batch) THEN 'verified' ELSE 'needs_review' END AS state FROM s""")
def identity_from_texts(spark, sf_dir):
    i, none = F.col("c_custkey"), F.lit(None).cast("string")
    k, w = i % 7, i % 5
    bio = F.when(k == 1, joined("Co-founder of Acme Works ", i, " (YC S2026)")).when(k == 3, joined("we build acme-works", i)).when(k == 4, "Y Combinator S2026").when(k == 5, "founder").otherwise(none)
    rows = read(spark, sf_dir, "customer").select(
        i.alias("id"), F.when(i % 2 == 0, "company").otherwise("founder").alias("entity_type"), F.when(i % 2 == 0, joined("Acme Works ", i)).otherwise(joined("Ann Lee ", i)).alias("name"), joined("Acme Works ", i).alias("company_name"), F.lit("S2026").alias("batch"),
        joined("https://www.acme", i, ".com").alias("website"), none.alias("explicit"), F.when(k.isin(0, 1), F.when(i % 2 == 0, joined("acme-works ", i)).otherwise(joined("ann lee", i))).alias("display_name"), F.when(k == 2, F.when(i % 2 == 0, joined("AcmeWorks", i)).otherwise(joined("annlee", i))).alias("handle"),
        bio.alias("bio"), F.when(w == 0, joined("https://acme", i, ".com/about")).alias("site"), F.lit(False).alias("verified"), (k == 6).alias("on_official_site"), F.when(w == 1, F.to_timestamp(F.lit("2026-05-01"))).when(w == 2, F.to_timestamp(F.lit("2025-05-01"))).alias("active_at"),
    )
    return a.identity(a.identity_signals(rows, F.lit("2026-06-01").cast("timestamp"))).select("id", "n_matches", "state")


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN c_custkey % 4 = 0 WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS matches FROM customer""")
def profile_identity(spark, sf_dir):
    i, none = F.col("c_custkey"), F.lit(None).cast("string")
    k = i % 6
    rows = read(spark, sf_dir, "customer").select(
        i.alias("id"), F.when(k.isin(3, 4), "founder").otherwise("company").alias("entity_type"), F.lit("Ann").alias("name"), joined("Acme Works", i).alias("company_name"), joined("https://acme", i, ".com").alias("website"), F.when(k == 1, "Web Instagram search").alias("reason"),
        F.when(k.isin(1, 2), joined("Acme Works", i)).when(k.isin(3, 4), "ANN").otherwise("other").alias("display_name"), F.when(k == 0, joined("https://acme", i, ".com/x")).alias("external"), F.when(k == 3, joined("at acme", i)).otherwise(none).alias("bio"),
        F.when(i % 4 == 0, 500).otherwise(20).alias("followers"),
    )
    return a.profile_matches(rows).select("id", "matches")


@query("""SELECT page_id, 'Acme ' || page_id AS name, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'medium' ELSE 'low' END AS reliability FROM pages WHERE page_id % 3 < 2""")
def search_records(spark, sf_dir):
    i = F.col("page_id")
    url = F.when(i % 3 == 0, joined("https://www.ycombinator.com/companies/", i)).when(i % 3 == 1, "https://news.com/yc").otherwise("https://other.com/a")
    rows = read(spark, sf_dir, "pages").select("page_id", joined("Acme ", i, " | Directory").alias("title"), F.when(i % 2 == 0, "of s2026").otherwise("of now").alias("snippet"), url.alias("url"))
    return landed.search_records(rows, "S2026").select("page_id", "name", "reliability")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bYC\\s*(P26|S26|Spring\\s+2026)\\b') OR doc_id % 9 = 0")
def named_stories(spark, sf_dir):
    title = F.when(F.col("doc_id") % 9 == 0, "Launch HN (YC S26)").otherwise("News")
    return landed.stories(read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), "text")).select("doc_id")


@query("SELECT page_id, 0 AS place, 'a' || page_id AS video, 'First' AS title FROM pages UNION ALL SELECT page_id, 1, 'b', 'Second' FROM pages")
def embedded_videos(spark, sf_dir):
    item = lambda v, t: joined('{"videoId":"', v, '","x":1,"title":{"runs":[{"text":"', t, '"}]}}')
    first = joined("a", F.col("page_id"))
    return landed.embedded_videos(read(spark, sf_dir, "pages").select("page_id", F.concat(item(first, "First"), item(first, "Again"), item(F.lit("b"), "Second")).alias("html")), "page_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'a,b' END AS keys FROM events")
def entries_without_nulls(spark, sf_dir):
    made = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.when(F.col("event_id") % 2 == 1, F.col("value")))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(landed.drop_nulls(made))), ",").alias("keys"))
