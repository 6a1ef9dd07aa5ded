"""Queries over the evidence and discovery operators and over the functions that read texts, dates and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as t, text as x, urls as u
from tidemark.functions.num import jround
from tidemark.operators import discovery as d, evidence as v
from tidemark.plans.adapters import read
from tidemark.plans.registry import registry

QUERIES, ORACLE, query = registry()


def by(key, n, *values):
    """One of the values by a key's remainder; SQL: list[key % n + 1]."""
    return F.element_at(F.array(*[F.lit(None).cast("string") if w is None else F.lit(w) for w in values]), (F.col(key) % n + 1).cast("int"))


def joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Evidence. Events as landed records.

LANDED = """l AS (SELECT event_id AS id, user_id AS entity_id, ['x', 'linkedin', 'instagram', 'hacker_news', 'web', 'youtube'][event_id % 6 + 1] AS platform, value AS contribution, ts AS last_updated_at, CASE WHEN event_id % 5 <> 0 THEN ts - INTERVAL 1 DAY END AS posted_at,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'https://x.com/acme' ELSE 'https://x.com/acme/status/' || event_id END WHEN 1 THEN 'https://www.linkedin.com/posts/person' || (event_id % 3) || '_launch-' || event_id WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'https://instagram.com/reel/R' || event_id || '/' ELSE 'not a url' END
    WHEN 3 THEN 'https://news.ycombinator.com/item?id=' || event_id WHEN 4 THEN 'https://example.org/a' ELSE 'https://www.youtube.com/watch?v=v' || event_id END AS source_url,
  CASE WHEN event_id % 11 = 0 THEN 'invalid' END AS link_status, CASE WHEN event_id % 3 = 0 THEN 'Acme (YC S26) launches' ELSE 'Acme launches' END AS title, CASE WHEN event_id % 7 <> 0 THEN 'text ' || event_id ELSE '' END AS text, CASE WHEN event_id % 12 = 0 THEN '{"is_retweet": true}' END AS raw,
  ['verified', 'needs_review', 'rejected'][event_id % 3 + 1] AS state FROM events)"""


def landed(spark, sf_dir):
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    m = lambda k: i % 6 == k
    url = F.when(m(0), F.when(i % 4 == 0, "https://x.com/acme").otherwise(joined("https://x.com/acme/status/", i))).when(m(1), joined("https://www.linkedin.com/posts/person", i % 3, "_launch-", i))
    url = url.when(m(2), F.when(i % 4 == 0, joined("https://instagram.com/reel/R", i, "/")).otherwise("not a url")).when(m(3), joined("https://news.ycombinator.com/item?id=", i)).when(m(4), "https://example.org/a").otherwise(joined("https://www.youtube.com/watch?v=v", i))
    return e.select(
        i.alias("id"), F.lit("company").alias("entity_type"), F.col("user_id").alias("entity_id"), by("event_id", 6, "x", "linkedin", "instagram", "hacker_news", "web", "youtube").alias("platform"), F.col("value").alias("contribution"),
        F.col("ts").alias("last_updated_at"), F.when(i % 5 != 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("posted_at"), url.alias("source_url"), F.when(i % 11 == 0, "invalid").alias("link_status"),
        F.when(i % 3 == 0, "Acme (YC S26) launches").otherwise("Acme launches").alias("title"), F.when(i % 7 != 0, joined("text ", i)).otherwise("").alias("text"), F.when(i % 12 == 0, '{"is_retweet": true}').alias("raw"),
        F.lit(None).cast("string").alias("post"), F.lit("found").alias("match_reason"), by("event_id", 3, "verified", "needs_review", "rejected").alias("state"),
    )


@query(f"""WITH {LANDED} SELECT id FROM l WHERE link_status IS NULL AND CASE platform WHEN 'linkedin' THEN (id % 3 = 0 AND entity_id % 2 = 0) OR (id % 3 = 1 AND entity_id % 2 = 1) WHEN 'hacker_news' THEN contains(title, 'YC S26') ELSE true END""")
def accepted_evidence(spark, sf_dir):
    known = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), joined("person", F.col("user_id") % 2).alias("handle")).distinct()
    return v.accepted(landed(spark, sf_dir), known).select("id")


@query(f"""WITH {LANDED}, k AS (SELECT *, platform IN ('x', 'linkedin', 'instagram') AND CASE platform WHEN 'x' THEN NOT contains(source_url, '/status/') WHEN 'instagram' THEN NOT contains(source_url, '/reel/') ELSE false END AS profile, platform = 'x' AND raw IS NOT NULL AS retweet FROM l)
SELECT id, epoch_us(coalesce(posted_at, last_updated_at)) AS posted_us, CASE WHEN text <> '' THEN text ELSE title END AS text, CASE WHEN platform = 'web' OR retweet OR profile THEN 0 ELSE contribution END AS contribution,
  CASE platform WHEN 'x' THEN nullif(regexp_extract(source_url, '/status/([0-9]+)', 1), '') WHEN 'linkedin' THEN regexp_extract(source_url, '/posts/(.*)', 1) WHEN 'instagram' THEN nullif(regexp_extract(source_url, '/reel/([^/]+)', 1), '') WHEN 'hacker_news' THEN id::VARCHAR WHEN 'youtube' THEN 'v' || id END AS post,
  CASE WHEN retweet THEN 'retweet' WHEN profile THEN 'profile' ELSE 'found' END AS why FROM k""")
def projected_evidence(spark, sf_dir):
    return v.project(landed(spark, sf_dir)).select("id", t.micros(F.col("posted_at")).alias("posted_us"), "text", "contribution", "post", "why")


@query(f"WITH {LANDED} SELECT id FROM l WHERE platform IN ('x', 'youtube', 'web') AND state = 'verified'")
def verified_source_rows(spark, sf_dir):
    return v.verified_sources(landed(spark, sf_dir), ["x", "youtube", "web"]).select("id")


@query(f"WITH {LANDED} SELECT id, CASE WHEN platform = 'instagram' THEN 0 ELSE contribution END AS contribution, CASE WHEN platform = 'instagram' THEN 'needs_review' ELSE state END AS state FROM l")
def quarantined_evidence(spark, sf_dir):
    verified = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.lit("acme").alias("handle")).distinct()
    return v.quarantined(landed(spark, sf_dir), verified).select("id", "contribution", "state")


@query("""WITH a AS (SELECT s_suppkey AS entity_id, s_suppkey % 4 <> 0 AS fetched, s_acctbal / 100 AS profile_score FROM supplier), r AS (SELECT ps AS entity_id, 'r' || o_orderkey AS name, o_custkey AS stars, o_custkey % 7 AS forks, (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE <= 30 AS recent, floor(o_totalprice / 1000) AS score
    FROM (SELECT *, o_orderkey % (SELECT 2 * count(*) FROM supplier) AS ps FROM orders)
), p AS (SELECT a.entity_id, 'profile' AS kind, 'login' || a.entity_id AS name, coalesce(sum(stars), 0)::BIGINT AS stars, coalesce(sum(forks), 0)::BIGINT AS forks, coalesce(sum(recent::INTEGER), 0)::INTEGER AS recent, CASE WHEN count(r.name) > 0 THEN 0 ELSE any_value(profile_score) END AS contribution FROM a LEFT JOIN r USING (entity_id) WHERE fetched GROUP BY 1
), u AS (SELECT * FROM p UNION ALL SELECT entity_id, 'repo', name, stars, forks, recent::INTEGER, score FROM r WHERE entity_id IN (SELECT entity_id FROM a WHERE fetched)
), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY contribution DESC, kind, name) AS k FROM u)
SELECT entity_id, kind, name, stars, forks, recent, contribution FROM k WHERE k <= 20""")
def repository_evidence(spark, sf_dir):
    s, o = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "orders")
    accounts = s.select(F.col("s_suppkey").alias("entity_id"), joined("login", F.col("s_suppkey")).alias("login"), (F.col("s_suppkey") % 4 != 0).alias("fetched"), (F.col("s_acctbal") / 100).alias("profile_score"))
    repos = o.select((F.col("o_orderkey") % (2 * s.count())).alias("entity_id"), joined("r", F.col("o_orderkey")).alias("name"), F.col("o_custkey").alias("stars"), (F.col("o_custkey") % 7).alias("forks"), F.col("o_orderdate").alias("pushed_at"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))
    return v.repository_evidence(accounts, repos, F.lit(o.agg(F.max("o_orderdate")).first()[0]))


@query("""WITH r AS (SELECT o_custkey AS entity_id, o_orderkey, o_orderkey % 900 AS stars, o_orderkey % 70 AS forks, (epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS days FROM orders
), s AS (SELECT *, least(100, floor(14 * ln(1 + stars) + 9 * ln(1 + forks) + 3 * ln(1 + stars) + 1.5::DOUBLE * ln(1 + forks) + CASE WHEN days <= 45 THEN 8 WHEN days <= 180 THEN 3 ELSE 0 END + 0.5))::DOUBLE AS score FROM r
), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, 'r' || o_orderkey) AS k FROM s)
SELECT entity_id, count(*) AS n_repos, sum(stars)::BIGINT AS stars, sum(forks)::BIGINT AS forks, max(score) AS best, floor(avg(score) FILTER (k <= 5) * 100 + 0.5) / 100 AS top5 FROM k GROUP BY 1""")
def account_totals(spark, sf_dir):
    o, i = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    repos = o.select(F.col("o_custkey").alias("entity_id"), joined("r", i).alias("name"), (i % 900).alias("stars"), (i % 70).alias("forks"), (i % 900).alias("watchers"), (i % 70).alias("issues"), F.col("o_orderdate").alias("pushed_at"))
    return v.account_totals(repos, F.lit(o.agg(F.max("o_orderdate")).first()[0]))


@query("SELECT event_id FROM events WHERE value > 0 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) + value > 0 AND ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def still_counting(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("ts").alias("posted_at"), F.create_map(F.lit("views"), F.col("value"), F.lit("none"), F.lit(None).cast("double")).alias("metrics"))
    return v.still_counts(rows, F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 7 DAY")).select("event_id")


# Discovery. Customers as entities, with texts and addresses of theirs or of others.

MET = """m AS (SELECT c_custkey AS id, 'Customer ' || c_custkey AS name, 'customer-' || c_custkey AS slug, 'https://www.customer' || c_custkey || '.com' AS website, 'Ann Lee' || c_custkey AS member, c_custkey % 2 = 0 AS own, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey * 10 + 7 END AS o, c_custkey % 5 AS k FROM customer
), w AS (SELECT *, CASE k WHEN 0 THEN 'The startup Customer ' || o || ' is here' WHEN 1 THEN 'ann lee' || o || ', founder, talks' WHEN 2 THEN 'see customer' || o || '.com now' WHEN 3 THEN 'Access Denied' ELSE 'a launch by customer ' || o || '.' END AS text,
  CASE k WHEN 0 THEN 'https://blog.customer' || o || '.com/a' WHEN 1 THEN 'https://x.com/a/status/1' WHEN 2 THEN 'https://www.linkedin.com/in/a' WHEN 3 THEN 'no url' ELSE 'https://www.ycombinator.com/c' END AS url FROM m
), f AS (SELECT *, lower(text) AS l, k <> 3 AND (contains(lower(text), lower(name)) OR contains(lower(text), 'customer' || id)) AS named, contains(lower(text), lower(member)) AS told, k = 0 AND regexp_matches(url, '(^https://|\\.)customer' || id || '\\.com/') AS home, contains(lower(text), 'customer' || id) AS site FROM w)"""


def met(spark, sf_dir):
    k = F.col("c_custkey")
    o, m = F.when(k % 2 == 0, k).otherwise(k * 10 + 7), lambda j: k % 5 == j
    text = F.when(m(0), joined("The startup Customer ", o, " is here")).when(m(1), joined("ann lee", o, ", founder, talks")).when(m(2), joined("see customer", o, ".com now")).when(m(3), "Access Denied").otherwise(joined("a launch by customer ", o, "."))
    url = F.when(m(0), joined("https://blog.customer", o, ".com/a")).when(m(1), "https://x.com/a/status/1").when(m(2), "https://www.linkedin.com/in/a").when(m(3), "no url").otherwise("https://www.ycombinator.com/c")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), joined("Customer ", k).alias("name"), joined("customer-", k).alias("slug"), joined("https://www.customer", k, ".com").alias("website"), joined("Ann Lee", k).alias("member"), text.alias("text"), url.alias("url"),
        F.element_at(F.array(*map(F.lit, ["x", "linkedin", "instagram"])), (k % 3 + 1).cast("int")).alias("platform"),
    )


@query(f"WITH {MET} SELECT id, named, told, home, (named OR told) AND (home OR site OR regexp_matches(text, '(?i)\\b(YC|Y Combinator|startup|founder|co[- ]?founder|launch|product)\\b')) AS strong FROM f")
def public_match(spark, sf_dir):
    c = F.col
    rows = met(spark, sf_dir)
    return rows.select("id", d.names_entity(c("name"), c("website"), c("text")).alias("named"), d.names_member(c("member"), c("text")).alias("told"), d.on_own_site(c("website"), c("url")).alias("home"), d.strong_match(c("name"), c("website"), c("member"), c("text"), c("url")).alias("strong"))


@query(f"""WITH {MET} SELECT id, k = 3 AS blocked, CASE WHEN k IN (3, 4) THEN false ELSE true END AS third_party, k = 1 AND id % 3 = 0 AS is_post, CASE WHEN k = 3 THEN false ELSE CASE id % 3 WHEN 0 THEN k = 1 WHEN 1 THEN k = 2 ELSE false END END AS fits FROM f""")
def url_tests(spark, sf_dir):
    c = F.col
    return met(spark, sf_dir).select("id", d.blocked(c("text")).alias("blocked"), d.third_party(c("website"), c("url")).alias("third_party"), d.is_post(c("platform"), c("url")).alias("is_post"), d.fits_platform(c("platform"), c("url")).alias("fits"))


@query(f"WITH {MET} SELECT id FROM f WHERE CASE id % 3 WHEN 0 THEN k = 1 WHEN 1 THEN k = 2 ELSE false END AND id % 4 <> 0")
def useful_reviews(spark, sf_dir):
    rows = met(spark, sf_dir).withColumn("entity_id", F.col("id"))
    return d.useful_reviews(rows, rows.withColumn("state", F.col("id") % 4).filter("state = 0")).select("id")


@query(f"""WITH {MET}, r AS (SELECT id, CASE id % 3 WHEN 0 THEN 'Customer' || id || '-HQ' WHEN 1 THEN 'other' ELSE 'cust' END AS owner FROM m) SELECT id, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS fits FROM r""")
def repository_candidates(spark, sf_dir):
    owner = F.when(F.col("id") % 3 == 0, joined("Customer", F.col("id"), "-HQ")).when(F.col("id") % 3 == 1, "other").otherwise("cust")
    return met(spark, sf_dir).select("id", d.repository_fits(owner, F.col("website"), F.col("slug")).alias("fits"))


@query(f"""WITH {MET}, q AS (SELECT *, CASE id % 3 WHEN 0 THEN name || ' launches' WHEN 1 THEN name ELSE 'Other' END AS title, CASE id % 4 WHEN 0 THEN 'fast payroll tools' WHEN 1 THEN 'customer-' || id WHEN 2 THEN 'ANN LEE' || id ELSE 'nothing' END AS body FROM m)
SELECT id, CASE WHEN id % 3 = 2 THEN NULL WHEN contains(lower(title || ' ' || body), 'customer' || id) THEN 'domain' WHEN id % 4 = 1 THEN 'slug' WHEN id % 4 = 2 THEN 'member' WHEN id % 4 = 0 THEN 'words' END AS verified_by FROM q""")
def launch_verification(spark, sf_dir):
    i = F.col("id")
    title = F.when(i % 3 == 0, F.concat("name", F.lit(" launches"))).when(i % 3 == 1, F.col("name")).otherwise("Other")
    body = F.when(i % 4 == 0, "fast payroll tools").when(i % 4 == 1, F.col("slug")).when(i % 4 == 2, F.upper("member")).otherwise("nothing")
    rows = met(spark, sf_dir).withColumns({"title": title, "text": body, "words": F.array(F.lit("fast"), F.lit("payroll"), F.lit("tools"), F.lit("of"))})
    return d.launch_verified(rows).select("id", "verified_by")


@query(f"""WITH {MET} SELECT id, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN contains('https://p.com/customer-1', 'customer-' || id) OR contains('a customer', 'customer') AND (id < 100 OR contains('https://p.com/customer-1', id::VARCHAR)) ELSE contains('https://p.com/posts/x' || id, 'customer') END AS fits FROM m""")
def launch_candidates(spark, sf_dir):
    i = F.col("id")
    title = F.when(i % 4 == 0, F.col("name")).when(i % 4 == 1, "a customer").otherwise("a tool")
    url = F.when(i % 4 == 1, "https://p.com/customer-1").otherwise(joined("https://p.com/posts/x", i))
    return met(spark, sf_dir).select("id", d.launch_candidate(F.col("name"), F.col("slug"), title, url).alias("fits"))


@query("""WITH l AS (SELECT ['x', 'github'][o_orderkey % 2 + 1] AS platform, o_custkey AS entity_id, 'https://' || CASE WHEN o_orderkey % 3 = 0 THEN 'www.' ELSE '' END || 'a.com/U' || (o_orderkey % 3) || CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE '' END AS url, o_orderkey AS ordinal, 0 AS f FROM orders
  UNION ALL SELECT 'x', c_custkey, 'http://A.com/u' || (c_custkey % 4), c_custkey, 1 FROM customer
), k AS (SELECT *, regexp_replace(lower(regexp_replace(url, '^https?://(www\\.)?', '')), '[/?#]*$', '') AS k FROM l)
SELECT platform, entity_id, arg_max(url, f::BIGINT * 1000000000000 + ordinal) AS url FROM k GROUP BY platform, entity_id, k""")
def target_collection(spark, sf_dir):
    i = F.col("o_orderkey")
    url = joined("https://", F.when(i % 3 == 0, "www.").otherwise(""), "a.com/U", i % 3, F.when(i % 5 == 0, "/").otherwise(""))
    links = read(spark, sf_dir, "orders").select(by("o_orderkey", 2, "x", "github").alias("platform"), F.col("o_custkey").alias("entity_id"), url.alias("url"), i.alias("ordinal"))
    overrides = read(spark, sf_dir, "customer").select(F.lit("x").alias("platform"), F.col("c_custkey").alias("entity_id"), joined("http://A.com/u", F.col("c_custkey") % 4).alias("url"), F.col("c_custkey").alias("ordinal"))
    return d.targets(links, overrides)


@query("""WITH r AS (SELECT o_custkey AS entity_id, 'Own' || (o_orderkey % 3) AS owner, CASE WHEN o_orderkey % 7 <> 0 THEN 'r' || (o_orderkey % 4) END AS repo, ['link', 'page', 'search'][o_orderkey % 3 + 1] AS source, o_orderkey FROM orders
), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, owner, coalesce(repo, '') ORDER BY CASE source WHEN 'link' THEN 0 WHEN 'page' THEN 1 ELSE 99 END, source) AS k FROM r), o AS (SELECT DISTINCT entity_id, owner FROM r WHERE repo IS NULL)
SELECT entity_id, owner, repo, source FROM k WHERE k = 1 AND (repo IS NULL OR (entity_id, owner) NOT IN (SELECT (entity_id, owner) FROM o))""")
def covered_targets(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), joined("Own", i % 3).alias("owner"), F.when(i % 7 != 0, joined("r", i % 4)).alias("repo"), by("o_orderkey", 3, "link", "page", "search").alias("source"))
    return d.covered_targets(rows, {"link": 0, "page": 1})


@query("""SELECT user_id, arg_min('u' || event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END * 1000000000 + event_id) AS url FROM events WHERE event_type <> 'error' GROUP BY 1""")
def first_choice_urls(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "signup", "needs_review").when(F.col("event_type") == "error", "rejected").otherwise("found")
    return d.first_choice(read(spark, sf_dir, "events").select("user_id", state.alias("state"), joined("u", F.col("event_id")).alias("url"), F.col("event_id").alias("ordinal")), "user_id")


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 3 = 1 THEN p_brand END AS b, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 END AS s FROM part WHERE p_partkey % 5 <> 4)
SELECT p_partkey, CASE WHEN b IS NOT NULL AND b <> p_brand THEN b ELSE p_brand END AS p_brand, CASE WHEN s IS NOT NULL THEN s ELSE p_size END AS p_size, coalesce(b <> p_brand, false)::INTEGER + (s IS NOT NULL)::INTEGER AS changed FROM part LEFT JOIN f USING (p_partkey)""")
def backfill_patch(spark, sf_dir):
    part, k = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.col("p_partkey")
    found = part.withColumn("some", k % 5 != 4).filter("some").select("p_partkey", F.when(k % 3 == 0, "new").when(k % 3 == 1, F.col("p_brand")).alias("p_brand"), F.when(k % 2 == 0, F.col("p_size") + 1).alias("p_size"))
    return d.patched(part, found, "p_partkey", ["p_brand", "p_size"])


@query("""SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'skipped' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'found' WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'needs_review' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'no_results' END AS status FROM events GROUP BY 1""")
def connector_status(spark, sf_dir):
    n = lambda k: F.count_if(F.col("event_type") == k)
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("f"), n("signup").alias("r"), n("error").alias("e"))
    return rows.select("user_id", d.attempt_status(F.col("f"), F.col("r"), F.col("e"), F.col("user_id") % 9 == 0).alias("status"))


@query("""SELECT count(*) AS n_targets, count(*) FILTER (value > 20) AS n_attempted, count(*) FILTER (value > 20 AND k = 0 AND event_type <> 'error') AS n_empty, count(*) FILTER (event_type = 'error') AS n_failed, count(DISTINCT user_id) FILTER (k > 0) AS n_entities
FROM (SELECT *, event_id % 4 AS k FROM events)""")
def target_coverage(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), (F.col("value") > 20).alias("attempted"), (F.col("event_id") % 4).alias("found"), (F.col("event_type") == "error").alias("failed"))
    return d.target_coverage(rows)


# Texts, dates and metrics.


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'S' || y WHEN 1 THEN 'W' || y WHEN 2 THEN 'S' || y WHEN 3 THEN 'W' || y ELSE 'FALL' || y END AS slug, CASE o_orderkey % 5 WHEN 0 THEN 'Spring ' || y WHEN 1 THEN 'Winter ' || y WHEN 2 THEN 'Spring ' || y WHEN 3 THEN 'Winter ' || y ELSE 'FALL' || y END AS label
FROM (SELECT o_orderkey, 2000 + o_orderkey % 90 AS y FROM orders)""")
def batch_slugs(spark, sf_dir):
    i, y = F.col("o_orderkey"), 2000 + F.col("o_orderkey") % 90
    raw = F.when(i % 5 == 0, joined(" yc  spring ", y)).when(i % 5 == 1, joined("YC Winter ", y)).when(i % 5 == 2, joined("s ", y)).when(i % 5 == 3, joined("w", y)).otherwise(joined("Fall ", y))
    return read(spark, sf_dir, "orders").select("o_orderkey", x.batch_slug(raw).alias("slug"), x.batch_label(raw).alias("label"))


@query("""SELECT p_partkey, p_name || ' and ' || p_brand AS plain, 'https://a.com/' || p_partkey AS url, p_name AS label FROM part""")
def markdown_links(spark, sf_dir):
    md = joined("![img](https://a.com/i.png) [", F.col("p_name"), "](https://a.com/", F.col("p_partkey"), ")  and ", F.col("p_brand"))
    link = F.get(x.markdown_links(md), F.lit(0))
    return read(spark, sf_dir, "part").select("p_partkey", F.trim(x.without_links(md)).alias("plain"), link["url"].alias("url"), link["label"].alias("label"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) - (event_id % 50) * 60000000 WHEN 1 THEN epoch_us(ts) - (event_id % 50) * 3600000000 WHEN 2 THEN epoch_us(ts) - (event_id % 50) * 86400000000 WHEN 3 THEN epoch_us(make_timestamp(year(ts), 6, event_id % 28 + 1, 0, 0, 0)) ELSE -1 END AS at_us FROM events""")
def relative_dates(spark, sf_dir):
    i, n = F.col("event_id"), F.col("event_id") % 50
    label = F.when(i % 5 == 0, joined(n, "m")).when(i % 5 == 1, joined(n, "h ago")).when(i % 5 == 2, joined(n, " days ago")).when(i % 5 == 3, joined("Jun ", i % 28 + 1)).otherwise("some day")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(t.micros(t.spoken(label, F.col("ts").cast("timestamp"))), F.lit(-1)).alias("at_us"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '2020-01-05' END AS day, strftime(greatest(o_orderdate, TIMESTAMP '1997-01-01'), '%Y-%m-%d') AS latest FROM orders""")
def dates_in_texts(spark, sf_dir):
    i, o = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(i % 4 == 0, joined("x. Posted: ", F.date_format(o, "MMMM d, yyyy"), ". y")).when(i % 4 == 1, joined("on ", F.date_format(o, "yyyy-MM-dd"), " we")).when(i % 4 == 2, "Published Jan 5, 2020 by").otherwise("no date")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select("o_orderkey", day(t.date_within(text)).alias("day"), day(t.latest(day(o), F.lit("1997-01-01"), F.lit("bad"))).alias("latest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN l_quantity * 1000 >= 1000 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'K likes' END, CASE WHEN l_linenumber > 2 THEN l_linenumber::VARCHAR || ' comments' END, CASE WHEN l_tax > 0.02 THEN '7 views' END, '5 stars', '6 forks'], lambda q: q IS NOT NULL)[1:4], ' | ') AS pills FROM lineitem""")
def metric_pills(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    m = F.create_map(F.lit("likes"), F.col("l_quantity") * 1000, F.lit("comments"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("double")).otherwise(0.0), F.lit("views"), F.when(F.col("l_tax") > 0.02, 7.0), F.lit("stars"), F.lit(5.0), F.lit("forks"), F.lit(6.0))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(x.metric_pills(m, ["likes", "comments", "shares", "views", "stars", "forks"]), " | ").alias("pills"))


HASHED = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(p_name), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * {0} + c) % {1})"


@query(f"""SELECT p_partkey, ['#F09EA7', '#F6CA94', '#FAFABE', '#C1EBC0', '#C7CAFF', '#CDABEB', '#F6C2F3'][{HASHED.format(31, 9973)} % 7 + 1] AS colour, floor(({HASHED.format(33, 1009)} / 1009.0::DOUBLE - 0.5::DOUBLE) * 10 * 1e6 + 0.5) / 1e6 AS shift FROM part""")
def group_colours(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", x.group_colour(F.col("p_name")).alias("colour"), jround(x.jitter(F.lower("p_name"), 10.0), 6).alias("shift"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(p_type), lower(p_brand), 'tools', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])), ',') AS tags FROM part""")
def tag_sets(spark, sf_dir):
    words = F.split("p_name", " ")
    tags = x.tag_set(F.col("p_type"), F.array("p_brand", "p_type"), joined("Tools -> ", F.get(words, F.lit(0)), "->"), words)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("""SELECT c_custkey, 'we shipped ' || c_mktsegment AS text FROM customer""")
def post_clean_up(spark, sf_dir):
    raw = joined("Customer ", F.col("c_custkey"), "  we shipped ", F.col("c_mktsegment"), " See more 5h ago • Follow")
    return read(spark, sf_dir, "customer").select("c_custkey", x.post_text(raw, joined("Customer ", F.col("c_custkey"))).alias("text"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS handle_of, split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '.', 1) AS root, true AS same FROM pages""")
def url_roots(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", u.host(url).alias("handle_of"), u.domain_root(url).alias("root"), u.same_host(url, F.concat(F.lit("https://www."), u.host(url), F.lit("/x"))).alias("same"))


@query("""SELECT c_custkey, least(greatest(coalesce(CASE WHEN c_custkey % 5 <> 0 THEN floor(c_acctbal / 100) END, 10), 1), 50)::INTEGER AS "limit" FROM customer""")
def limits(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", d.limit_between(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 100)).alias("limit"))
