"""Queries over graph views, review queues, further scoring models, audits and what landed pages give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.num import jround
from tidemark.functions.urls import canonical_account
from tidemark.operators import audits as q, dedupe as d, graph as g, scoring as s
from tidemark.operators.config import LIBRARY_PLATFORMS
from tidemark.plans.adapters import read
from tidemark.plans.evidence import by, joined
from tidemark.plans.registry import registry
from tidemark.session import durable, new_dir
from tidemark.sources import landed, nested
from tidemark.streaming import cooldown, incremental

QUERIES, ORACLE, query = registry()

# A graph query: parts as nodes, consecutive parts of a brand as edges, line items as evidence, suppliers' offers as review rows.

FILTERS = g.Filters(min_score=20, industries=("ECONOMY", "PROMO", "STANDARD"), partners=("Brand#2", "Brand#4", "Brand#17", "Brand#5"), platforms=("x", "github"))
VIEW = """n AS (SELECT p_partkey AS id, p_name AS label, p_brand AS partner, p_type AS industry, p_size * 2.0::DOUBLE AS score, [['x', 'web', 'github'][p_partkey % 3 + 1], 'rss'] AS platforms FROM part
), kept AS (SELECT * FROM n WHERE score >= 20 AND industry IN ('ECONOMY', 'PROMO', 'STANDARD') AND partner IN ('Brand#2', 'Brand#4', 'Brand#17', 'Brand#5') AND (list_contains(platforms, 'x') OR list_contains(platforms, 'github'))
), chain AS (SELECT lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS source, p_partkey AS target FROM part
), ev AS (SELECT l_orderkey, l_linenumber, l_partkey AS entity_id, l_suppkey, ['x', 'web', 'github'][l_linenumber % 3 + 1] AS platform FROM lineitem)"""


def view(spark, sf_dir):
    part, l = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    nodes = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("partner"), F.col("p_type").alias("industry"), F.lit("b2b").alias("model"), F.array(by("p_partkey", 3, "x", "web", "github"), F.lit("rss")).alias("platforms"), (F.col("p_size") * 2.0).alias("score"),
    )
    edges = g.chain_edges(part.withColumnRenamed("p_partkey", "id"), "p_brand", F.desc("p_retailprice"), "p_name", "id")
    evidence = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entity_id"), "l_suppkey", by("l_linenumber", 3, "x", "web", "github").alias("platform"))
    return g.query(nodes, edges, evidence, evidence.filter("l_suppkey > 5"), FILTERS)


@query(f"WITH {VIEW} SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM kept")
def graph_view_leaderboard(spark, sf_dir):
    return view(spark, sf_dir).leaderboard


@query(f"WITH {VIEW} SELECT source, target FROM chain WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def graph_view_edges(spark, sf_dir):
    return view(spark, sf_dir).edges.select("source", "target")


@query(f"WITH {VIEW} SELECT l_orderkey, l_linenumber, entity_id, l_suppkey, platform FROM ev WHERE entity_id IN (SELECT id FROM kept) AND platform IN ('x', 'github')")
def graph_view_evidence(spark, sf_dir):
    return view(spark, sf_dir).evidence.select("l_orderkey", "l_linenumber", "entity_id", "l_suppkey", "platform")


@query(f"WITH {VIEW} SELECT count(*) AS n FROM ev WHERE entity_id IN (SELECT id FROM kept) AND platform IN ('x', 'github') AND l_suppkey > 5")
def graph_view_review(spark, sf_dir):
    return view(spark, sf_dir).review.agg(F.count("*").alias("n"))


@query(f"""WITH {VIEW}, m AS (SELECT id, (id % 13)::DOUBLE AS gain, id % 5 AS rank_gain FROM n WHERE id % 4 <> 0), j AS (SELECT k.id, k.score, m.gain, m.rank_gain FROM kept k JOIN m ON k.id = m.id)
SELECT id, gain, rank_gain, row_number() OVER (ORDER BY gain DESC, rank_gain DESC, score DESC, id)::INTEGER AS place FROM j""")
def attached_momentum(spark, sf_dir):
    i = F.col("p_partkey")
    m = read(spark, sf_dir, "part").select(i.alias("id"), (i % 13).cast("double").alias("gain"), (i % 5).alias("rank_gain"), (i % 4).alias("k")).filter("k <> 0").drop("k")
    return g.attach(view(spark, sf_dir).leaderboard, m, "id").select("id", "gain", "rank_gain", "place")


@query("""WITH a AS (SELECT 'company' AS entity_type, s_suppkey AS entity_id, s_name AS entity_name, ['x', 'github', 'web'][s_suppkey % 3 + 1] AS platform, ['verified', 'needs_review', 'rejected'][s_suppkey % 4 % 3 + 1] AS state FROM supplier
  UNION ALL SELECT 'founder', c_custkey, c_name, ['x', 'github', 'web'][c_custkey % 3 + 1], ['verified', 'needs_review', 'rejected'][c_custkey % 4 % 3 + 1] FROM customer)
SELECT entity_type, entity_id, state, row_number() OVER (ORDER BY CASE state WHEN 'needs_review' THEN 0 ELSE 1 END, entity_name, entity_type, entity_id, platform) AS place FROM a WHERE state <> 'verified' AND platform IN ('x', 'github')""")
def review_queue(spark, sf_dir):
    of = lambda table, key, name, kind: read(spark, sf_dir, table).select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), F.col(name).alias("entity_name"), by(key, 3, "x", "github", "web").alias("platform"), (F.col(key) % 4).alias("k"))
    rows = of("supplier", "s_suppkey", "s_name", "company").unionByName(of("customer", "c_custkey", "c_name", "founder"))
    rows = rows.withColumn("state", by("k", 3, "verified", "needs_review", "rejected"))
    return g.review_queue(rows, ("x", "github")).select("entity_type", "entity_id", "state", "place")


@query("SELECT DISTINCT o_custkey AS source, unnest([o_orderkey % 50, o_orderkey % 7]) AS target, 1.0::DOUBLE AS weight FROM orders")
def member_edges(spark, sf_dir):
    i = F.col("o_orderkey")
    return g.member_edges(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.array(i % 50, i % 7).alias("entity_ids")))


HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 1009)"
LAID = f"""p AS (SELECT p_partkey AS id, p_type AS cluster, p_name AS label, p_retailprice AS score, (p_size % 30)::DOUBLE AS radius FROM part
), z AS (SELECT cluster, count(*) AS size, greatest(max(radius), 20) AS widest FROM p GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster) - 1 AS c, count(*) OVER () AS many FROM z
), r AS (SELECT p.*, c.c, c.widest, c.many, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, label, id) - 1 AS n FROM p JOIN c USING (cluster)
), k AS (SELECT *, sqrt(c) * greatest(205, least(300, 840 / sqrt(greatest(many, 1)))) AS o, c * (pi() * (3 - sqrt(5.0::DOUBLE))) - pi() / 2 AS turn, CASE WHEN n = 0 THEN 0 ELSE sqrt(n) * greatest(52, least(84, widest * 1.05::DOUBLE)) + widest * 0.38::DOUBLE END AS reach,
    n * (pi() * (3 - sqrt(5.0::DOUBLE))) + ({HASH.format("id::VARCHAR")} / 1009.0::DOUBLE - 0.5) * 0.45::DOUBLE AS own FROM r
), placed AS (SELECT id, cluster, cos(turn) * o * 1.16::DOUBLE + cos(own) * reach + ({HASH.format("id::VARCHAR || ':x'")} / 1009.0::DOUBLE - 0.5) * 10 AS x, sin(turn) * o * 0.88::DOUBLE + sin(own) * reach * 0.78::DOUBLE + ({HASH.format("id::VARCHAR || ':y'")} / 1009.0::DOUBLE - 0.5) * 8 AS y FROM k)"""


def laid(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return g.spiral(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cluster"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 30).cast("double").alias("radius")))


@query(f"WITH {LAID} SELECT id, floor(x * 1000 + 0.5) / 1000 AS x, floor(y * 1000 + 0.5) / 1000 AS y FROM placed")
def spiral_positions(spark, sf_dir):
    return laid(spark, sf_dir).select("id", jround(F.col("x"), 3).alias("x"), jround(F.col("y"), 3).alias("y"))


@query(f"WITH {LAID} SELECT cluster, floor(avg(x) * 100 + 0.5) / 100 AS x, floor(avg(y) * 100 + 0.5) / 100 AS y, count(*) AS n FROM placed GROUP BY 1")
def cluster_centroids(spark, sf_dir):
    return g.centroids(laid(spark, sf_dir)).select("cluster", jround(F.col("x"), 2).alias("x"), jround(F.col("y"), 2).alias("y"), "n")


# Scoring models.

TOTALS = """b AS (SELECT c_nationkey * 1000 + c_custkey % 40 AS entity_id, ['x', 'linkedin', 'github', 'youtube', 'reddit'][c_custkey % 5 + 1] AS platform, greatest(c_acctbal, 0) / 100 AS score, ['verified', 'verified', 'needs_review', 'rejected'][c_custkey % 4 + 1] AS state FROM customer
), p AS (SELECT *, CASE platform WHEN 'x' THEN 0.25 WHEN 'linkedin' THEN 0.15 WHEN 'github' THEN 0.2 WHEN 'youtube' THEN 0.1 ELSE 0 END::DOUBLE AS w FROM b), o AS (SELECT *, w > 0 AND score > 0 AND state = 'verified' AS ok FROM p
), a AS (SELECT entity_id, count(*) FILTER (ok) AS n, coalesce(sum(w) FILTER (ok), 0) AS weight, coalesce(sum(score * w) FILTER (ok) / sum(w) FILTER (ok), 0) AS mean, bool_or(state = 'verified') AS v, bool_and(state = 'rejected') AS r FROM o GROUP BY 1
), t AS (SELECT *, floor(floor(mean * 100 + 0.5) / 100 * CASE WHEN n > 0 THEN 0.85::DOUBLE + 0.15::DOUBLE * sqrt(n / 6.0::DOUBLE) ELSE 0 END * 100 + 0.5) / 100 AS absolute FROM a
), k AS (SELECT *, ((rank() OVER (ORDER BY absolute) - 1) + count(*) OVER (PARTITION BY absolute) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM t)"""


@query(f"""WITH {TOTALS} SELECT entity_id, absolute, floor(pct * 100 * 100 + 0.5) / 100 AS total, floor(least(1, weight) * 1e6 + 0.5) / 1e6 AS coverage, CASE WHEN v THEN 'verified' WHEN r THEN 'rejected' ELSE 'needs_review' END AS review_state FROM k""")
def composite_totals(spark, sf_dir):
    return s.composite_total(account_rows(spark, sf_dir), LIBRARY_PLATFORMS).select("entity_id", "absolute", "total", jround(F.col("coverage"), 6).alias("coverage"), "review_state")


def account_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 40).alias("entity_id"), by("c_custkey", 5, "x", "linkedin", "github", "youtube", "reddit").alias("platform"), (F.greatest("c_acctbal", F.lit(0.0)) / 100).alias("score"), by("c_custkey", 4, "verified", "verified", "needs_review", "rejected").alias("state"))


@query(f"""WITH {TOTALS} SELECT entity_id, absolute, floor(pct * 100 * 100 + 0.5) / 100 AS total, entity_id % 3 = 0 AS known, CASE WHEN entity_id % 3 = 0 THEN least(1, entity_id % 7 / 5.0::DOUBLE) ELSE 0.85 END::DOUBLE AS relevance FROM k""")
def founder_totals(spark, sf_dir):
    rows = account_rows(spark, sf_dir)
    relevance = rows.select("entity_id").distinct().filter("entity_id % 3 = 0").withColumn("relevance", F.col("entity_id") % 7 / 5.0)
    return s.founder_scores(rows, relevance).select("entity_id", "absolute", "total", "known", "relevance")


DEMO = """m AS (SELECT event_id, user_id, ['x', 'linkedin', 'reddit'][event_id % 3 + 1] AS platform, floor((event_id % 50) * 1 + (event_id % 9) * 3 + value * 0.05::DOUBLE + (event_id % 4) * 1.5::DOUBLE) AS raw FROM events
), n AS (SELECT *, cume_dist() OVER (PARTITION BY platform ORDER BY raw) * 100 AS normalized FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, platform ORDER BY normalized DESC, event_id) AS k FROM n
), b AS (SELECT user_id AS entity_id, platform, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 'needs_review' ELSE 'verified' END AS state, CASE WHEN user_id % 3 = 0 THEN 0 ELSE least(100, 0.75::DOUBLE * avg(normalized) FILTER (k <= 5) + 0.15::DOUBLE * least(100, count(*) / 5.0::DOUBLE * 100) + 10) END AS score FROM k GROUP BY user_id, platform)"""


def demo_posts(spark, sf_dir):
    from tidemark.operators.ranking import at_most_share

    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    m = F.create_map(F.lit("likes"), (i % 50).cast("double"), F.lit("comments"), (i % 9).cast("double"), F.lit("views"), F.col("value"), F.lit("upvotes"), (i % 4).cast("double"), F.lit("followers"), F.lit(1e6))
    rows = e.select(F.col("user_id").alias("entity_id"), by("event_id", 3, "x", "linkedin", "reddit").alias("platform"), F.floor(s.demo_raw(m)).cast("double").alias("raw"), i.alias("ordinal"), F.when(F.col("user_id") % 3 == 0, "needs_review").otherwise("verified").alias("state"))
    return at_most_share(rows, ["platform"], "raw", "p").withColumn("normalized", F.col("p") * 100)


@query(f"WITH {DEMO} SELECT entity_id, platform, n, floor(score * 10000 + 0.5) / 10000 AS score FROM b")
def demo_platform_scores(spark, sf_dir):
    return s.demo_platform_scores(demo_posts(spark, sf_dir)).select("entity_id", "platform", "n", jround(F.col("score"), 4).alias("score"))


@query(f"""WITH {DEMO}, w AS (SELECT *, CASE platform WHEN 'x' THEN 0.25 WHEN 'linkedin' THEN 0.15 ELSE 0.05 END::DOUBLE AS w FROM b)
SELECT entity_id, floor(sum(score * w) / sum(w) * 10000 + 0.5) / 10000 AS total, CASE WHEN bool_or(state = 'verified') THEN 'verified' ELSE 'needs_review' END AS review_state, floor(least(1, 0.65::DOUBLE + 0.08::DOUBLE * count(*)) * 100 + 0.5) / 100 AS penalty FROM w GROUP BY 1""")
def demo_entity_scores(spark, sf_dir):
    out = s.demo_entity_scores(s.demo_platform_scores(demo_posts(spark, sf_dir)))
    return out.select("entity_id", jround(F.col("total"), 4).alias("total"), "review_state", jround(F.col("penalty"), 2).alias("penalty"))


FEATURES = """f AS (SELECT c_custkey AS entity_id, (c_custkey * 37) % 101 AS score, c_custkey % 7 AS n_evidence, (c_custkey * 991) % 150000 AS views, (c_custkey * 577) % 8000 AS stars, (c_custkey % 10) / 10.0::DOUBLE AS top_share, c_custkey % 5 AS n_platforms, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 13) % 100 END AS code, (c_custkey * 7) % 100 AS social FROM customer
), lists AS (
  SELECT 'top' AS list, entity_id, row_number() OVER (ORDER BY score DESC, entity_id) AS k, 25 AS most FROM f UNION ALL SELECT 'one_platform', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE top_share >= 0.85 UNION ALL SELECT 'cross_platform', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE n_platforms >= 3
  UNION ALL SELECT 'sparse', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE score >= 50 AND n_evidence <= 2 UNION ALL SELECT 'high_code_low_social', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE coalesce(code, 0) >= 70 AND social < 30
  UNION ALL SELECT 'viral_low_code', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE social >= 60 AND coalesce(code, 0) < 30 UNION ALL SELECT 'high_code_low_total', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 25 FROM f WHERE stars >= 1000 AND score < 45
  UNION ALL SELECT 'bottom', entity_id, row_number() OVER (ORDER BY score, entity_id DESC), 25 FROM f UNION ALL SELECT 'views_low_score', entity_id, row_number() OVER (ORDER BY views DESC, entity_id), 25 FROM f WHERE views >= 50000 AND score < 50
  UNION ALL SELECT 'formula_issues', entity_id, row_number() OVER (ORDER BY score DESC, entity_id), 30 FROM f WHERE (score >= 70 AND n_evidence <= 1) OR (views >= 100000 AND score < 40) OR (stars >= 5000 AND coalesce(code, 0) < 65)), cut AS (SELECT list, entity_id FROM lists WHERE k <= most)"""


def experiment(spark, sf_dir):
    i = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        i.alias("entity_id"), (i * 37 % 101).alias("score"), (i % 7).alias("n_evidence"), (i * 991 % 150_000).alias("views"), (i * 577 % 8000).alias("stars"), (i % 10 / 10.0).alias("top_share"), (i % 5).alias("n_platforms"),
        F.when(i % 3 == 0, i * 13 % 100).cast("double").alias("code"), (i * 7 % 100).alias("social"),
    )
    return s.experiment_lists(rows)


@query(f"WITH {FEATURES} SELECT list, entity_id FROM cut")
def experiment_lists(spark, sf_dir):
    return experiment(spark, sf_dir)


@query(f"WITH {FEATURES}, c AS (SELECT *, ['a', 'b'][entity_id % 2 + 1] AS config FROM cut) SELECT config, floor((2 * count(*) FILTER (list = 'cross_platform') - count(*) FILTER (list = 'sparse') - 0.2 * count(*) FILTER (list = 'views_low_score') - 0.1 * count(*) FILTER (list = 'one_platform') + 3) * 10 + 0.5)::DOUBLE / 10 AS value FROM c GROUP BY 1")
def config_quality(spark, sf_dir):
    return s.config_quality(experiment(spark, sf_dir).withColumn("config", by("entity_id", 2, "a", "b")), F.lit(3)).select("config", jround(F.col("value"), 1).alias("value"))


@query("SELECT event_type, coalesce(sum(CASE WHEN user_id % 5 > 0 THEN value * (user_id % 5) END) / sum(CASE WHEN user_id % 5 > 0 THEN user_id % 5 END), -1) > 0 AS positive FROM events GROUP BY 1")
def weighted_averages(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg((s.weighted_average(F.col("value"), F.col("user_id") % 5, -1.0) > 0).alias("positive"))


# Duplicates and sources of entities.

RELIABLE = "r AS (SELECT o_custkey AS k, o_orderkey, ['high', 'medium', 'low', 'unknown'][o_orderkey % 4 + 1] AS reliability FROM orders), n AS (SELECT *, CASE reliability WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM r)"


def reliable(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ordinal"), by("o_orderkey", 4, "high", "medium", "low", "unknown").alias("reliability"))


@query(f"WITH {RELIABLE} SELECT k, o_orderkey AS ordinal, reliability, CASE reliability WHEN 'high' THEN 'verified' ELSE 'needs_review' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank DESC, o_orderkey) AS p FROM n) WHERE p = 1")
def entities_by_reliability(spark, sf_dir):
    return d.by_reliability(reliable(spark, sf_dir), "k").withColumn("state", d.review_state_of(F.col("reliability")))


@query(f"WITH {RELIABLE} SELECT k % 100 AS k, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS reliability FROM n GROUP BY 1")
def strongest_reliability(spark, sf_dir):
    return d.strongest_reliability(reliable(spark, sf_dir).withColumn("k", F.col("k") % 100), ["k"])


@query("""WITH k AS (SELECT user_id || ':' || event_type AS key, event_id, 'u' || (event_id % 3) AS url, epoch_us(ts) AS t FROM events)
SELECT key, count(*) AS n, array_to_string(list_sort(list(event_id))[1:10], ',') AS ids, array_to_string(list_sort(list(DISTINCT url))[1:10], ',') AS urls, max(t) AS latest FROM k GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(joined(F.col("user_id"), ":", F.col("event_type")).alias("key"), "event_id", joined("u", F.col("event_id") % 3).alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = d.duplicate_groups(rows, "key", "event_id", "url", "at")
    return out.select("key", "n", F.array_join("ids", ",").alias("ids"), F.array_join("urls", ",").alias("urls"), "latest")


@query("""WITH a AS (SELECT s_nationkey AS e, 'x' AS p, 'x.com/u' || (s_suppkey % 4) AS k FROM supplier UNION ALL SELECT c_nationkey, 'x', 'x.com/u' || (c_custkey % 6) FROM customer) SELECT e AS entity_id, p || ':' || k AS account, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_accounts(spark, sf_dir):
    none = F.lit(None).cast("string")
    a = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.lit("x").alias("platform"), joined("https://www.X.com/U", F.col("s_suppkey") % 4, "/").alias("url"), none.alias("handle"))
    m = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.lit("x").alias("platform"), joined("https://twitter.com/u", F.col("c_custkey") % 6).alias("url"), none.alias("handle"))
    return d.duplicate_accounts(a, m, canonical_account(F.col("url"), F.col("handle")))


@query("""WITH k AS (SELECT event_id, event_type AS platform, CASE event_id % 4 WHEN 0 THEN event_type || ':post:id ' || (event_id % 20) WHEN 1 THEN event_type || ':url:https://a.com/p' || (event_id % 30) WHEN 2 THEN event_type || ':fallback:acc:ann:hello ' || (event_id % 10) ELSE event_type || ':fallback:acc:ann:' END AS key FROM events) SELECT event_id, key FROM k""")
def evidence_keys(spark, sf_dir):
    i = F.col("event_id")
    post = F.when(i % 4 == 0, joined("ID ", i % 20))
    url = F.when(i % 4 == 1, joined("https://www.a.com/p", i % 30, "?utm_source=q#top")).otherwise("bad")
    text = F.when(i % 4 == 2, joined("Hello  ", i % 10))
    return read(spark, sf_dir, "events").select("event_id", d.evidence_key(F.col("event_type"), post, url, F.lit("ACC"), F.lit("Ann"), text).alias("key"))


# Audits.


@query("""SELECT event_type AS platform, count(*) AS n_rows, count(*) FILTER (event_id % 4 IN (0, 3)) AS n_pictures, count(*) FILTER (event_id % 4 = 1) AS n_stand_ins, count(*) FILTER (event_id % 4 = 2) AS n_missing FROM events GROUP BY 1""")
def picture_coverage(spark, sf_dir):
    picture = by("event_id", 4, "https://a/p.png", "/media/x.svg?v=1", None, "https://a/q.jpg")
    return q.picture_coverage(read(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), picture.alias("picture")))


AUDITED = """e AS (SELECT event_id AS id, user_id AS entity_id, event_type AS platform, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS score, CASE WHEN event_id % 50 = 1 THEN 'needs_review' ELSE 'verified' END AS state, CASE WHEN event_id % 40 = 1 THEN '' ELSE 'u' END AS url, event_id % 60 <> 1 AS timed, event_id % 200 AS post, event_id % 70 = 1 AS profile FROM events
), n AS (SELECT user_id AS entity_id, floor(avg(value)) + 40 AS score, count(DISTINCT event_type) AS kinds, min(value) - 5 AS best, user_id % 2 AS odd FROM events GROUP BY 1), s AS (SELECT entity_id, count(*) FILTER (score > 0) AS k FROM e GROUP BY 1
), f AS (SELECT 'high' AS severity, 'graph.duplicate_ids' AS "check", count(*) - count(DISTINCT id) AS n FROM e UNION ALL SELECT 'high', 'evidence.scored_without_source', count(*) FILTER (score > 0 AND url = '') FROM e UNION ALL SELECT 'medium', 'evidence.scored_without_time', count(*) FILTER (score > 0 AND NOT timed) FROM e
  UNION ALL SELECT 'high', 'evidence.scored_not_verified', count(*) FILTER (score > 0 AND state <> 'verified') FROM e UNION ALL SELECT 'medium', 'evidence.profile_scored', count(*) FILTER (score > 0 AND profile) FROM e UNION ALL SELECT 'low', 'coverage.click', greatest(0, 1000000 - count(DISTINCT entity_id) FILTER (score > 0 AND platform = 'click')) FROM e
  UNION ALL SELECT 'low', 'coverage.view', greatest(0, 1 - count(DISTINCT entity_id) FILTER (score > 0 AND platform = 'view')) FROM e UNION ALL SELECT 'critical', 'duplicates.scored_post_cross_company', count(*) FROM (SELECT post FROM e WHERE score > 0 GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)
  UNION ALL SELECT 'high', 'graph.entity_count', abs(count(*) - 10) FROM n UNION ALL SELECT 'medium', 'scoring.high_score_sparse_evidence', count(*) FROM n LEFT JOIN s USING (entity_id) WHERE n.score >= 70 AND coalesce(k, 0) <= 2 UNION ALL SELECT 'medium', 'scoring.high_score_one_platform', count(*) FROM n WHERE score >= 80 AND odd = 1
  UNION ALL SELECT 'critical', 'ui.leaderboard_zero_contribution', count(*) FROM n WHERE best <= 0 UNION ALL SELECT 'medium', 'performance.slow', 3000 UNION ALL SELECT 'medium', 'observability.coverage_missing', 1)"""


@query(f"WITH {AUDITED} SELECT severity, \"check\", n FROM f WHERE n > 0")
def audit_findings(spark, sf_dir):
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    evidence = e.select(
        i.alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("platform"), F.when(i % 3 == 0, 0.0).otherwise(F.col("value")).alias("score"), F.when(i % 50 == 1, "needs_review").otherwise("verified").alias("state"),
        F.when(i % 40 == 1, "").otherwise("u").alias("source_url"), F.when(i % 60 != 1, F.col("ts")).alias("at"), (i % 200).alias("post_key"), (i % 70 == 1).alias("profile"),
    )
    nodes = e.groupBy(F.col("user_id").alias("entity_id")).agg((F.floor(F.avg("value")) + 40).alias("score"), (F.min("value") - 5).alias("best"))
    platforms = F.create_map(F.lit("x"), F.lit(5.0), F.lit("web"), F.when(F.col("entity_id") % 2 == 1, 0.0).otherwise(3.0))
    return q.audit_findings(evidence, nodes.withColumn("platform_scores", platforms), expected=10, floors={"click": 1_000_000, "view": 1}, elapsed_ms=3000.0, payload=10, reports={"coverage": False, "workers": True})


@query("SELECT event_type AS platform, sum(n)::BIGINT AS n_rows, count(*) AS n_entities, max(n) AS most FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def run_summary(spark, sf_dir):
    return q.run_summary(read(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("user_id").alias("entity_id")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20")
def last_failures(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    return q.last_failures(rows, "status", "event_id").select("event_id", "user_id")


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]{3}')) AS n_leaks FROM documents WHERE source = (SELECT min(source) FROM documents)")
def leak_audit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return q.leaks(docs, F.col("source") == docs.agg(F.min("source")).first()[0], "[0-9]{3}")


@query("""WITH p AS (SELECT event_id AS id, value AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS points FROM events)
SELECT id, points, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS priority FROM p ORDER BY CASE WHEN points >= 4 THEN 0 WHEN points >= 2 THEN 1 ELSE 2 END, score DESC, k DESC, id LIMIT 100""")
def review_priority(spark, sf_dir):
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(i.alias("id"), F.col("value").alias("score"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double")).alias("metrics"), (i % 2 == 0).alias("off_topic"), (i % 3 == 0).alias("no_signal"), (i % 5 == 0).alias("short"))
    return q.review_priority(rows, {"off_topic": 2, "no_signal": 2, "short": 1}).select("id", "points", "priority")


@query("""SELECT host, platform, state, reason, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, ['x', 'web'][page_id % 2 + 1] AS platform, ['verified', 'rejected'][page_id % 3 % 2 + 1] AS state, CASE WHEN page_id % 5 = 0 THEN 'linked' ELSE 'searched' END AS reason FROM pages)
GROUP BY 1, 2, 3, 4 ORDER BY n DESC, host, platform, state, reason LIMIT 30""")
def discovery_paths(spark, sf_dir):
    from tidemark.functions.urls import host
    from tidemark.operators.reports import discovery_paths as paths

    p = read(spark, sf_dir, "pages")
    return paths(p.select(host(F.col("url")).alias("host"), by("page_id", 2, "x", "web").alias("platform"), (F.col("page_id") % 3).alias("k"), F.when(F.col("page_id") % 5 == 0, "linked").otherwise("searched").alias("reason")).withColumn("state", by("k", 2, "verified", "rejected")))


# Landed pages and incremental forms.


@query("SELECT page_id, 1 AS rank, 'og' AS origin, 'https://a.com/' || page_id || '.png' AS image FROM pages UNION ALL SELECT page_id, 2, 'image', '/pic.png' FROM pages UNION ALL SELECT page_id, 3, 'image', '/logo.png' FROM pages")
def link_previews(spark, sf_dir):
    head = joined('<meta property="og:image" content="https://a.com/', F.col("page_id"), '.png"><img src="/logo.png"><img src="/pic.png">')
    return landed.link_previews(read(spark, sf_dir, "pages").select("page_id", head.alias("html")), "page_id")


@query("SELECT page_id, 'Title ' || page_id AS title, 'https://a/' || page_id AS link FROM pages UNION ALL SELECT page_id, 'Other', 'https://b/' || page_id FROM pages")
def feed_items(spark, sf_dir):
    feed = joined("<rss><item><title><![CDATA[Title ", F.col("page_id"), "]]></title><link>https://a/", F.col("page_id"), '</link></item></rss><feed><entry><title>Other</title><link href="https://b/', F.col("page_id"), '"/></entry></feed>')
    return landed.feed_items(read(spark, sf_dir, "pages").select("page_id", feed.alias("html"))).select("page_id", "title", "link")


@query("""WITH f AS (SELECT event_type AS platform, max(ts) AS t FROM events WHERE value > 20 GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT platform, epoch_us(t) + 1800000000 AS until_us FROM f, n WHERE epoch_us(t) + 1800000000 > epoch_us(now)""")
def platforms_cooling(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 20).alias("refused"))
    return incremental.cooling(rows, F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp")).select("platform", F.unix_micros("until").alias("until_us"))


@query("""WITH r AS (SELECT event_type AS platform, ts AS t, ts > max(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 30 MINUTE AS apart FROM events WHERE value > 20
), g AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY platform ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM r), i AS (SELECT platform, min(t) AS since, max(t) + INTERVAL 30 MINUTE AS until FROM g GROUP BY platform, g)
SELECT platform, epoch_us(since) AS since_us, epoch_us(until) AS until_us FROM i WHERE (epoch_us(until) + 999) // 1000 + 1 + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def streamed_cooldowns(spark, sf_dir):
    """Refusals as a stream in four batches; cooldowns that have ended by the last watermark."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 20).alias("refused"))
    first, last = e.agg(F.min("at"), F.max("at")).first()
    since = lambda t: F.unix_micros(t) - F.unix_micros(F.lit(first))
    quarter, landed_in, out = F.floor(since("at") * 3.999 / since(F.lit(last))), new_dir(spark, "attempts"), new_dir(spark, "cooldowns")
    for k in range(4):  # one after the other, as they come to lie
        e.filter(quarter == k).coalesce(1).write.mode("append").parquet(landed_in)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(landed_in)
    cooldown.write_cooldowns(stream, out, new_dir(spark, "checkpoint"), minutes=30, late="1 hour").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(cooldown.SCHEMA).parquet(out).select("platform", F.unix_micros("since").alias("since_us"), F.unix_micros("until").alias("until_us"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def streamed_upserts(spark, sf_dir):
    """Events as a stream in four batches, upserted by user."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    parts, path = durable(e.repartition(4, F.col("event_id") % 4), "batches"), new_dir(spark, "upserts")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(parts.inputFiles()[0].rsplit("/", 1)[0])
    q = incremental.write_upserts(stream, path, "user_id", "event_id", new_dir(spark, "checkpoint"), buckets=8).trigger(availableNow=True).start()
    q.awaitTermination()
    return incremental.read_upserts(spark, path, parts.schema, q.lastProgress["batchId"])


@query("""WITH s AS (SELECT DISTINCT event_type AS batch, ts FROM events WHERE extract(day FROM ts) % 3 = 0), now AS (SELECT max(ts) AS now FROM events), last AS (SELECT batch, max(ts) AS l FROM s GROUP BY 1), all_ AS (SELECT DISTINCT event_type AS batch FROM events
), due AS (SELECT batch, l IS NULL OR l::DATE <> now::DATE AS d FROM all_ LEFT JOIN last USING (batch), now), u AS (SELECT batch, 'daily' AS granularity, ts FROM s UNION ALL SELECT batch, 'daily', now FROM due, now WHERE d UNION ALL SELECT batch, 'weekly', now FROM all_, now
), k AS (SELECT *, row_number() OVER (PARTITION BY batch, granularity ORDER BY ts DESC) AS k FROM u)
SELECT batch, granularity, epoch_us(ts) AS at_us FROM k WHERE k <= CASE granularity WHEN 'daily' THEN 45 ELSE 20 END""")
def snapshot_append(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    stored = e.filter(F.dayofmonth("ts") % 3 == 0).select(F.col("event_type").alias("batch"), F.lit("daily").alias("granularity"), F.col("ts").cast("timestamp").alias("recorded_at"), F.lit(1).alias("entity_id")).distinct()
    current = e.select(F.col("event_type").alias("batch"), F.lit(1).alias("entity_id")).distinct()
    out = incremental.recorded(stored, current, F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp"), {"daily": 45, "weekly": 20})
    return out.select("batch", "granularity", F.unix_micros("recorded_at").alias("at_us"))


@query("""WITH f AS (SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS seen, CASE WHEN event_id % 4 = 0 THEN '2023-01-01' ELSE 'bad' END AS checked FROM events
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY greatest(coalesce(epoch_ms(seen::TIMESTAMP), 0), CASE WHEN checked = 'bad' THEN 0 ELSE epoch_ms(TIMESTAMP '2023-01-01') END) DESC, value * 1e6::DOUBLE + k DESC, event_id) AS p FROM f)
SELECT user_id, event_type, event_id FROM r WHERE p = 1""")
def fresh_survivors(spark, sf_dir):
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", joined(F.col("user_id"), ":", F.col("event_type")).alias("key"), F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("seen"), F.when(i % 4 == 0, "2023-01-01").otherwise("bad").alias("checked"),
        F.col("value").alias("contribution"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("none"), F.lit(None).cast("double")).alias("metrics"),
    )
    return d.fresh_survivors(rows, "key", ["seen", "checked"], ordinal="event_id").select("user_id", "event_type", "event_id")


@query("""WITH f AS (SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), r AS (
  SELECT 'newest' AS sort, event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM f UNION ALL SELECT 'likes', event_id, row_number() OVER (ORDER BY k DESC, event_id) FROM f UNION ALL SELECT 'platform', event_id, row_number() OVER (ORDER BY event_type, event_id) FROM f UNION ALL SELECT 'contribution', event_id, row_number() OVER (ORDER BY value DESC, event_id) FROM f)
SELECT sort, event_id FROM r WHERE p <= 20""")
def feeds(spark, sf_dir):
    from functools import reduce

    from tidemark.operators.ranking import feed

    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("posted_at"), F.col("event_type").alias("platform"), F.col("value").alias("contribution"), F.create_map(F.lit("likes"), F.get_json_object("props", "$.k").cast("double")).alias("metrics"))
    cut = lambda sort: feed(rows, sort, ordinal="event_id").select(F.lit(sort).alias("sort"), "event_id")
    return reduce(lambda x, y: x.unionByName(y), map(cut, ("newest", "likes", "platform", "contribution")))


@query("SELECT page_id, 0 AS place, 'https://github.com/acme/r' || page_id AS url FROM pages UNION ALL SELECT page_id, 1, 'https://github.com/acme' FROM pages")
def links_on_pages(spark, sf_dir):
    head = joined('<a href="https://github.com/acme/r', F.col("page_id"), "/\">r</a><a href='https://github.com/acme'>o</a><a href=\"https://github.com/acme\">o</a><a href=\"https://github.com/features\">f</a><a href=\"https://x.com/a\">x</a>")
    return landed.links_on_pages(read(spark, sf_dir, "pages").select("page_id", head.alias("html")), "page_id", "github.com", "/features$")


@query("""WITH h AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 150) AS h FROM events GROUP BY 1) SELECT user_id AS entity_id, coalesce(len(h), 0)::INTEGER AS n_have FROM h ORDER BY 2, 1 LIMIT 75""")
def weakest_coverage(spark, sf_dir):
    from tidemark.operators.reports import missing

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("platform"), "value")
    out = q.weakest(missing(e.select("entity_id").distinct(), ["click", "error", "purchase", "refund", "signup", "view"], e.filter("value > 150")))
    return out.select("entity_id", F.size("have").alias("n_have"))


#: Nations as nested records: their suppliers, and customers a level deeper.
@query("""SELECT n_nationkey, 0 AS ordinal, n_name AS name, NULL AS url, r_name AS tagline FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_name, NULL, c_mktsegment FROM customer
UNION ALL SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey), s_name, 'https://s' || s_suppkey || '.example', NULL FROM supplier""")
def nested_records(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("oneLiner")))).alias("customers"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("  "), "s_name").alias("name"), F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example")).alias("website")))).alias("suppliers"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    record = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("description"), "suppliers", F.struct("customers").alias("meta")))
    walked = nested.walk(n.select("n_nationkey", F.try_parse_json(record).alias("json")), "n_nationkey", "json")
    return nested.entity_records(walked, "n_nationkey", landed.NAME_FIELDS, landed.URL_FIELDS, landed.TAGLINE_FIELDS)


@query("SELECT event_id, j.key AS name, CASE WHEN j.type = 'VARCHAR' THEN j.value->>'$' ELSE CAST(j.value AS VARCHAR) END AS text FROM events, json_each(props) j")
def property_leaves(spark, sf_dir):
    """Every value in the properties of events."""
    walked = nested.walk(read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("json")), "event_id", "json")
    return nested.leaves(walked).select("event_id", "name", "text")


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]+"[^>]*>.*?</a>') AS a FROM pages), e AS (SELECT page_id, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS ordinal FROM a
), c AS (SELECT page_id, ordinal, regexp_extract(a, 'href="([^"]+)"', 1) AS url, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS name FROM e) SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, url, name FROM c WHERE url LIKE '/%' AND name <> ''""")
def page_cards(spark, sf_dir):
    """The links of real pages, as cards."""
    return landed.card_records(read(spark, sf_dir, "pages"), "page_id", "^/")


@query("""WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_filter(list_transform(list_concat(t, r), lambda x: trim(x)), lambda x: x <> ''), '|') AS texts, len(list_filter(list_transform(string_split_regex(t[1], ',| and '), lambda x: trim(x)), lambda x: x <> '')) AS n_people FROM l""")
def coerced_lists(spark, sf_dir):
    """Lists of strings and of objects, and names parted by commas or "and"."""
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("l"))
    listed = F.concat(F.transform("l", lambda x: F.parse_json(F.to_json(F.array(x["text"])))), F.transform("l", lambda x: F.parse_json(F.to_json(F.array(F.struct(x["role"].alias("title")))))))
    each = F.to_variant_object(F.transform(listed, lambda v: F.variant_get(v, "$[0]", "variant")))
    people = nested.people_of(F.to_variant_object(F.array(F.col("l")[0]["text"])))
    first = F.variant_get(F.to_variant_object(F.array(F.col("l")[0]["text"])), "$[0]", "variant")
    return t.select("conv_id", F.array_join(nested.texts_of(each), "|").alias("texts"), F.size(nested.people_of(first)).cast("long").alias("n_people"))


#: Users as nodes: their events are evidence, and two founders have the clicks and the views.
@query("""WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE value > 20
), c AS (SELECT *, list_aggregate(list_transform([5, 4, 3, 2, 1, 0], lambda d: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((n // CAST(power(36, d) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), 'string_agg', '') AS digits FROM k
), f AS (SELECT *, 'ev-' || CASE WHEN n = 0 THEN '0' ELSE ltrim(digits, '0') END AS id FROM c
), d AS (SELECT user_id, list(id ORDER BY event_id DESC) AS ids, list(id ORDER BY event_id) FILTER (event_type = 'click') AS clicks, list(id ORDER BY event_id) FILTER (event_type = 'view') AS views FROM f GROUP BY 1)
SELECT u.user_id AS id, coalesce(array_to_string(ids, ','), '') AS evidence_ids, coalesce(array_to_string(clicks, ','), '') AS clicks, coalesce(array_to_string(views, ','), '') AS views FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN d ON u.user_id = d.user_id""")
def sanitized_nodes(spark, sf_dir):
    return sanitized(spark, sf_dir).nodes.select("id", *[F.array_join(ids, ",").alias(out) for out, ids in (("evidence_ids", F.col("evidence_ids")), ("clicks", F.col("founders")[0]["evidence_ids"]), ("views", F.col("founders")[1]["evidence_ids"]))])


@query("SELECT event_id AS ordinal, row_number() OVER (ORDER BY event_id) AS n, '' AS why FROM events WHERE value > 20")
def sanitized_evidence(spark, sf_dir):
    e = sanitized(spark, sf_dir).evidence
    return e.select("ordinal", (F.conv(F.substr("id", F.lit(4)), 36, 10).cast("long") + 1).alias("n"), "why")


@query("""WITH b AS (SELECT user_id, arg_max(event_id, event_id) AS e, arg_max(value, event_id) AS v FROM events GROUP BY 1), k AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE value > 20)
SELECT user_id AS entity_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'e' || e END AS old, '' AS why FROM b LEFT JOIN k ON event_id = e""")
def sanitized_leaderboard(spark, sf_dir):
    rows = sanitized(spark, sf_dir).leaderboard
    new = F.startswith("biggest.id", F.lit("ev-"))
    return rows.select("entity_id", F.when(new, F.conv(F.substr("biggest.id", F.lit(4)), 36, 10).cast("long") + 1).otherwise(F.lit(0)).alias("n"), F.when(~new, F.col("biggest.id")).alias("old"), F.col("biggest.why").alias("why"))


def sanitized(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("e"), c)
    rows = e.select(name("event_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("user_id").alias("entity_id"), "event_type", F.greatest(F.col("value") - 20, F.lit(0.0)).alias("contribution"), F.lit("raw").alias("raw_visible_text"), F.lit("since").alias("match_reason"), F.lit("why").alias("why"))
    some = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type") == t, F.col("ordinal")))), name)
    founder = lambda n, t: F.struct(F.lit(n).alias("name"), some(t).alias("evidence_ids"))
    nodes = rows.groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list("ordinal"), False), name).alias("evidence_ids"), F.array(founder("a", "click"), founder("b", "view")).alias("founders"))
    board = rows.groupBy("entity_id").agg(F.max_by(F.struct("id", "why", "raw_visible_text", "match_reason", "contribution"), "ordinal").alias("biggest"))
    out = g.sanitize(nodes, rows, board)
    return g.Public(out.nodes, out.evidence.drop("entity_id", "event_type"), out.leaderboard)
