"""Queries over the scoring, ranking and snapshot operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.dates import micros
from tidemark.functions.num import jround
from tidemark.operators import ranking as r, scoring as s, snapshots as t
from tidemark.operators.config import LIBRARY_PLATFORMS
from tidemark.plans.adapters import evidence, read
from tidemark.plans.registry import registry

QUERIES, ORACLE, query = registry()

#: SQL of adapters.evidence, then of the live model step by step.
EVIDENCE = """ev AS (
  SELECT event_id AS ordinal, user_id AS entity_id, ts AS posted_at, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value > 1 AS eligible,
    CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'instagram' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'linkedin' WHEN 'error' THEN 'web' END AS platform FROM events)"""
RAW = EVIDENCE + """, own AS (SELECT *, CASE platform WHEN 'x' THEN value * 0.08::DOUBLE + k * 1.5::DOUBLE WHEN 'instagram' THEN value * 0.075::DOUBLE + k * 1.1::DOUBLE
    WHEN 'github' THEN value * 1.5::DOUBLE WHEN 'linkedin' THEN value * 0.08::DOUBLE + k * 1.5::DOUBLE ELSE 0 END AS o FROM ev
), raw AS (SELECT * EXCLUDE o, CASE WHEN o > 0 THEN o ELSE value * 0.08::DOUBLE + k * 1.5::DOUBLE END AS raw FROM own)"""
SCORED = RAW + """, aged AS (
  SELECT *, pow(0.5::DOUBLE, greatest(0, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(posted_at)) / 86400000000.0::DOUBLE)
    / CASE platform WHEN 'github' THEN 180 WHEN 'linkedin' THEN 60 WHEN 'x' THEN 45 WHEN 'instagram' THEN 45 ELSE 60 END::DOUBLE) AS recency FROM raw
), logged AS (SELECT *, ln(1 + raw * recency) AS logged, eligible AND platform <> 'web' AND raw * recency > 0 AS counts FROM aged
), ends AS (SELECT platform, min(logged) FILTER (counts) AS low, max(logged) FILTER (counts) AS high FROM logged GROUP BY 1
), scored AS (SELECT l.*, CASE WHEN NOT counts THEN 0 WHEN high = low THEN 50 ELSE floor(5 + 95 * (logged - low) / (high - low) + 0.5) END::DOUBLE AS score FROM logged l JOIN ends USING (platform))"""
BY_PLATFORM = SCORED + """, placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id, platform ORDER BY score DESC, ordinal) AS place FROM scored WHERE score > 0
), parts AS (SELECT entity_id, platform, count(*) AS n, max(score) AS best, avg(score) FILTER (place <= 3) AS top3, avg(score) FILTER (place <= 5) AS top5, avg(score) AS mean FROM placed GROUP BY 1, 2
), by_platform AS (SELECT entity_id, platform, n, floor(CASE WHEN platform = 'github' THEN 0.78::DOUBLE * best + 0.17::DOUBLE * top3 + 0.05::DOUBLE * least(100, ln(1 + n) / ln(21) * 100)
    WHEN platform IN ('x', 'instagram', 'linkedin') THEN 0.6::DOUBLE * best + 0.35::DOUBLE * top3 + 0.05::DOUBLE * least(100, n / 5 * 100)
    ELSE 0.7::DOUBLE * top5 + 0.2::DOUBLE * mean + 0.1::DOUBLE * least(100, n / 5 * 100) END + 0.5)::DOUBLE AS platform_score FROM parts
), weighed AS (SELECT *, CASE platform WHEN 'x' THEN 0.34 WHEN 'instagram' THEN 0.22 WHEN 'github' THEN 0.14 WHEN 'linkedin' THEN 0.14 END::DOUBLE AS w FROM by_platform)"""
#: The experiments' platform score has no branch for platforms of many views.
BY_PLATFORM_D = "".join(x for x in BY_PLATFORM.splitlines(keepends=True) if not x.strip().startswith("WHEN platform IN ('x', 'instagram', 'linkedin')"))
ENTITIES = BY_PLATFORM + """, entities AS (
  SELECT entity_id, count(*) AS n_platforms, CAST(sum(n) AS BIGINT) AS n_evidence, floor(sum(platform_score * w) / sum(w) * (0.85::DOUBLE + 0.15::DOUBLE * sqrt(count(*) / 7.0::DOUBLE)) + 0.5)::DOUBLE AS total
  FROM weighed WHERE w IS NOT NULL GROUP BY 1)"""
CALIBRATED = ENTITIES + """, held AS (SELECT *, CASE WHEN n_evidence > 0 THEN 0.72::DOUBLE + 0.28::DOUBLE * least(1, sqrt(n_evidence / 5.0::DOUBLE)) ELSE 0 END AS factor FROM entities
), range_ AS (SELECT min(total * factor) FILTER (total * factor > 0) AS low, max(total * factor) FILTER (total * factor > 0) AS high FROM held
), calibrated AS (SELECT held.*, CASE WHEN low IS NULL OR low = high THEN total WHEN total * factor <= 0 THEN 0
    ELSE floor(floor(pow((total * factor - low) / (high - low), 1.18::DOUBLE) * 100 + 0.5) * factor + 0.5) END::DOUBLE AS final FROM held, range_)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return e.withColumn("raw", s.raw_engagement(F.col("platform"), F.col("metrics")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = read(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))
    rows = raw(spark, sf_dir).crossJoin(F.broadcast(as_of))
    return s.evidence_scores(rows, F.col("as_of"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.entity_scores(s.platform_scores(scored(spark, sf_dir)))


@query(f"WITH {RAW} SELECT ordinal, platform, floor(raw * 1e6 + 0.5) / 1e6 AS raw FROM raw")
def raw_engagement(spark, sf_dir):
    return raw(spark, sf_dir).select("ordinal", "platform", jround(F.col("raw"), 6).alias("raw"))


@query(f"WITH {SCORED} SELECT ordinal, floor(recency * 1e6 + 0.5) / 1e6 AS recency FROM scored")
def recency_decay(spark, sf_dir):
    return scored(spark, sf_dir).select("ordinal", jround(F.col("recency"), 6).alias("recency"))


@query(f"WITH {SCORED} SELECT ordinal, platform, score FROM scored")
def log_minmax_score(spark, sf_dir):
    return scored(spark, sf_dir).select("ordinal", "platform", "score")


@query(f"WITH {BY_PLATFORM} SELECT entity_id, platform, n, platform_score FROM by_platform")
def platform_score_topk(spark, sf_dir):
    return s.platform_scores(scored(spark, sf_dir))


@query(f"WITH {ENTITIES} SELECT entity_id, n_platforms, n_evidence, total, row_number() OVER (ORDER BY total DESC, entity_id)::INTEGER AS rank FROM entities")
def balanced_entity_score(spark, sf_dir):
    return r.leaderboard(entities(spark, sf_dir), "total", "entity_id")


@query(f"WITH {BY_PLATFORM} SELECT entity_id, platform, floor(w / sum(w) OVER (PARTITION BY entity_id) * 1e6 + 0.5) / 1e6 AS share FROM weighed WHERE w IS NOT NULL")
def weight_shares(spark, sf_dir):
    return s.weight_shares(s.platform_scores(scored(spark, sf_dir))).select("entity_id", "platform", jround(F.col("share"), 6).alias("share"))


@query(f"WITH {CALIBRATED} SELECT entity_id, total, floor(factor * 1e6 + 0.5) / 1e6 AS factor, final FROM calibrated")
def batch_calibration(spark, sf_dir):
    return s.calibrate(entities(spark, sf_dir)).select("entity_id", "total", jround(F.col("factor"), 6).alias("factor"), "final")


@query("""SELECT c_custkey, floor(((rank() OVER k - 1) + count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY c_mktsegment) * 1e6 + 0.5) / 1e6 AS percentile
FROM customer WINDOW k AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)""")
def midrank_percentile(spark, sf_dir):
    return s.midrank(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "p").select("c_custkey", jround(F.col("p"), 6).alias("percentile"))


@query("""SELECT c_custkey, floor(coalesce((count(*) FILTER (s_acctbal < c_acctbal) + count(*) FILTER (s_acctbal = c_acctbal) / 2.0::DOUBLE) / nullif(count(s_acctbal), 0), 0.5::DOUBLE) * 1e6 + 0.5) / 1e6 AS percentile
FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey""")
def midrank_among_suppliers(spark, sf_dir):
    """Customers among the suppliers of their nation, whose values they mostly do not have."""
    balance = lambda t, p: read(spark, sf_dir, t).select(F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"), *(["c_custkey"] if p == "c" else []))
    out = s.midranks(balance("customer", "c"), ["nation"], {"balance": "p"}, balance("supplier", "s"))
    return out.select("c_custkey", jround(F.col("p"), 6).alias("percentile"))


@query("SELECT c_custkey, floor(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) * 1e6 + 0.5) / 1e6 AS percentile FROM customer")
def le_percentile(spark, sf_dir):
    return r.at_most_share(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "p").select("c_custkey", jround(F.col("p"), 6).alias("percentile"))


@query("""SELECT c_mktsegment, c_acctbal AS q68 FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE k = floor((n - 1) * 0.68::DOUBLE) + 1""")
def nearest_rank_quantile(spark, sf_dir):
    return r.nearest_rank(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 0.68, "q68")


@query("""SELECT s_suppkey, floor((5 + pow((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 2.2::DOUBLE) * 63) * 1e4 + 0.5) / 1e4 AS radius FROM supplier""")
def radius_minmax(spark, sf_dir):
    return r.radius(read(spark, sf_dir, "supplier"), "s_acctbal", 5, 68).select("s_suppkey", jround(F.col("radius"), 4).alias("radius"))


POSTS = """posts AS (
  SELECT event_id, user_id, event_type AS platform, value + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3 AS raw,
    (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0::DOUBLE AS age, c_acctbal AS followers FROM events LEFT JOIN customer ON c_custkey = user_id
), v AS (SELECT *, ln(1 + raw) AS l, raw / greatest(abs(followers), 1) AS rate, ln(1 + raw) * pow(0.5::DOUBLE, age / 30) AS m FROM posts
), p AS (SELECT *, ((rank() OVER (PARTITION BY platform ORDER BY l) - 1) + count(*) OVER (PARTITION BY platform, l) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY platform) AS pl,
    CASE WHEN rate IS NULL THEN 0.5 ELSE ((rank() OVER (PARTITION BY platform, rate IS NULL ORDER BY rate) - 1) + count(*) OVER (PARTITION BY platform, rate) / 2.0::DOUBLE) / count(rate) OVER (PARTITION BY platform) END AS pr,
    ((rank() OVER (PARTITION BY platform ORDER BY m) - 1) + count(*) OVER (PARTITION BY platform, m) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY platform) AS pm FROM v
), post_scores AS (SELECT *, floor(100 * (0.5::DOUBLE * pl + 0.3::DOUBLE * pr + 0.2::DOUBLE * pm) * 100 + 0.5) / 100 AS post_score FROM p)"""


def posts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts").alias("as_of"))
    followers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("followers"))
    age = (micros(F.col("as_of")) - micros(F.col("ts"))) / 86_400_000_000.0
    rows = e.join(followers, "user_id", "left").crossJoin(F.broadcast(as_of))
    return s.post_scores(rows.select("event_id", "user_id", F.col("event_type").alias("platform"), (F.col("value") + F.get_json_object("props", "$.k").cast("double") * 3).alias("raw"), age.alias("age_days"), "followers"))


@query(f"WITH {POSTS} SELECT event_id, post_score FROM post_scores")
def post_score_library(spark, sf_dir):
    return posts(spark, sf_dir).select("event_id", "post_score")


@query(f"""WITH {POSTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, platform ORDER BY post_score DESC, event_id) AS place FROM post_scores
), a AS (SELECT user_id, platform, avg(post_score) FILTER (place <= 5) AS t, count(*) AS n FROM k GROUP BY 1, 2)
SELECT user_id AS entity_id, platform, n, CASE WHEN user_id % 3 = 0 THEN 'needs_review' ELSE 'verified' END AS review_state,
  CASE WHEN user_id % 3 = 0 THEN 0 ELSE floor((0.75::DOUBLE * t + 0.15::DOUBLE * (floor(least(n, 5) / 5.0::DOUBLE * 100 * 100 + 0.5) / 100) + 0.10::DOUBLE * 50) * 100 + 0.5) / 100 END AS score FROM a""")
def account_score_library(spark, sf_dir):
    state = F.when(F.col("user_id") % 3 == 0, "needs_review").otherwise("verified")
    rows = posts(spark, sf_dir).select(F.col("user_id").alias("entity_id"), "platform", "post_score", F.col("event_id").alias("ordinal"), state.alias("review_state"), F.lit(None).cast("double").alias("follower_percentile"))
    return s.account_scores(rows)


#: Nations as companies: suppliers are their official accounts, customers their members'; names of platforms by key.
ROLLUP = """r AS (
  SELECT s_nationkey AS entity_id, true AS official, s_acctbal / 100 AS score, ['x', 'linkedin', 'github'][s_suppkey % 3 + 1] AS platform FROM supplier
  UNION ALL SELECT c_nationkey, false, c_acctbal / 100, ['x', 'linkedin', 'youtube'][c_custkey % 3 + 1] FROM customer
), b AS (SELECT entity_id, platform, avg(score) FILTER (official) AS o, avg(score) FILTER (NOT official) AS m FROM r GROUP BY 1, 2
), v AS (SELECT entity_id, platform, (coalesce(o * 0.6::DOUBLE, 0) + coalesce(m * 0.4::DOUBLE, 0)) / (CASE WHEN o IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN m IS NULL THEN 0 ELSE 0.4::DOUBLE END) AS v,
    CASE platform WHEN 'x' THEN 0.25 WHEN 'linkedin' THEN 0.15 WHEN 'github' THEN 0.2 ELSE 0.1 END::DOUBLE AS w FROM b)"""


@query(f"WITH {ROLLUP} SELECT entity_id, floor(sum(v * w) / sum(w) * 100 + 0.5) / 100 AS absolute, count(*) AS n_platforms FROM v GROUP BY 1")
def company_founder_rollup(spark, sf_dir):
    pick = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % 3 + 1).cast("int"))
    o = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.lit(True).alias("official"), (F.col("s_acctbal") / 100).alias("score"), pick("s_suppkey", "x", "linkedin", "github").alias("platform"))
    m = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.lit(False).alias("official"), (F.col("c_acctbal") / 100).alias("score"), pick("c_custkey", "x", "linkedin", "youtube").alias("platform"))
    return s.composite(o.unionByName(m), LIBRARY_PLATFORMS)


@query("""SELECT source, CASE WHEN bool_or(st = 'verified') THEN 'verified' WHEN bool_and(st = 'rejected') THEN 'rejected' ELSE 'needs_review' END AS review_state
FROM (SELECT source, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND n_chars > 4000 THEN 'verified' ELSE 'needs_review' END AS st FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def review_state_rollup(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    state = F.when(F.col("toxic") == 1, "rejected").when((F.col("quality") == 1) & (F.col("n_chars") > 4000), "verified").otherwise("needs_review")
    return s.review_rollup(both.withColumn("st", state), "source", "st")


@query(f"""WITH {RAW}, g AS (SELECT platform, sqrt(count(DISTINCT entity_id) + 1.0::DOUBLE) * sqrt(var_pop(ln(1 + raw)) + 1) AS g FROM raw GROUP BY 1)
SELECT platform, floor(g / sum(g) OVER () * 1e6 + 0.5) / 1e6 AS weight FROM g""")
def learned_weights(spark, sf_dir):
    return s.learned_weights(raw(spark, sf_dir)).select("platform", jround(F.col("weight"), 6).alias("weight"))


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders""")
def leaderboard(spark, sf_dir):
    return r.leaderboard(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice", "rank")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1""")
def leaderboard_top1(spark, sf_dir):
    return r.best_row(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_orders(spark, sf_dir):
    return r.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), "o_orderkey")


@query("""WITH m AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS a, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS b FROM orders GROUP BY 1
), e AS (SELECT o_custkey, CAST(coalesce(a, 0) AS DOUBLE) AS now, CAST(coalesce(b, 0) AS DOUBLE) AS before FROM m
), k AS (SELECT *, row_number() OVER (ORDER BY now DESC, o_custkey)::INTEGER AS rank_now, row_number() OVER (ORDER BY before DESC, o_custkey)::INTEGER AS rank_before, floor((now - before) * 100 + 0.5) / 100 AS gain FROM e)
SELECT o_custkey, rank_now, rank_before, gain, rank_before - rank_now AS rank_gain, row_number() OVER (ORDER BY gain DESC, rank_before - rank_now DESC, now DESC, o_custkey)::INTEGER AS place FROM k""")
def fastest_gaining_rerank(spark, sf_dir):
    price, late = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(late, price)), F.lit(0)).cast("double").alias("now"), F.coalesce(F.sum(F.when(~late, price)), F.lit(0)).cast("double").alias("before"))
    return r.fastest_gaining(rows, "now", "before", "o_custkey").select("o_custkey", "rank_now", "rank_before", "gain", "rank_gain", "place")


#: Events by day as snapshots: a user's values so far today, recorded at the day's last event of its type.
SNAPS = """s AS (
  SELECT event_type AS batch, 'daily' AS granularity, max(ts) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS recorded_at, user_id AS entity_id, CAST(value AS DECIMAL(18, 2)) AS value FROM events
), g AS (SELECT batch, granularity, recorded_at, entity_id, CAST(sum(value) AS DOUBLE) AS score FROM s GROUP BY 1, 2, 3, 4
), snaps AS (SELECT *, row_number() OVER (PARTITION BY batch, recorded_at ORDER BY score DESC, entity_id)::INTEGER AS rank FROM g)"""


def snaps(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("ts").alias("recorded_at"))
    rows = e.withColumn("day", F.to_date("ts")).join(days, ["event_type", "day"])
    rows = rows.groupBy(F.col("event_type").alias("batch"), F.lit("daily").alias("granularity"), "recorded_at", F.col("user_id").alias("entity_id")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("batch", "recorded_at").orderBy(F.desc("score"), "entity_id")))


@query(f"""WITH {SNAPS}, d AS (SELECT max(CAST(recorded_at AS DATE)) AS d FROM snaps), now AS (SELECT * FROM snaps, d WHERE CAST(recorded_at AS DATE) = d
), b1 AS (SELECT * FROM snaps, d WHERE CAST(recorded_at AS DATE) = d - 1), b7 AS (SELECT * FROM snaps, d WHERE CAST(recorded_at AS DATE) = d - 7)
SELECT n.batch, n.entity_id, n.score, n.rank, floor(coalesce(n.score - b1.score, 0) * 10 + 0.5) / 10 AS day_delta, floor(coalesce((n.score - b1.score) / greatest(b1.score, 1) * 100, 0) * 10 + 0.5) / 10 AS day_percent, coalesce(b1.rank - n.rank, 0) AS day_ranks,
  floor(coalesce(n.score - b7.score, 0) * 10 + 0.5) / 10 AS week_delta, floor(coalesce((n.score - b7.score) / greatest(b7.score, 1) * 100, 0) * 10 + 0.5) / 10 AS week_percent, coalesce(b7.rank - n.rank, 0) AS week_ranks
FROM now n LEFT JOIN b1 ON n.batch = b1.batch AND n.entity_id = b1.entity_id LEFT JOIN b7 ON n.batch = b7.batch AND n.entity_id = b7.entity_id""")
def momentum_dod_wow(spark, sf_dir):
    all_ = snaps(spark, sf_dir)
    day = F.lit(read(spark, sf_dir, "events").agg(F.max(F.to_date("ts"))).first()[0])
    out = t.baseline(all_, day, 0).select("batch", "entity_id", "score", "rank")
    return t.momentum(t.momentum(out, t.baseline(all_, day, 1), "day"), t.baseline(all_, day, 7), "week")


@query(f"""WITH {SNAPS} SELECT batch, epoch_us(recorded_at) AS recorded_us, entity_id, score FROM (SELECT *, dense_rank() OVER (PARTITION BY batch, granularity ORDER BY recorded_at DESC) AS k FROM snaps) WHERE k <= 20""")
def snapshot_retention(spark, sf_dir):
    return t.retained(snaps(spark, sf_dir), {"daily": 20, "weekly": 20}).select("batch", micros(F.col("recorded_at")).alias("recorded_us"), "entity_id", "score")


@query("""WITH w AS (SELECT event_type AS batch, max(ts) AS d, max(ts) FILTER (extract(day FROM ts) <= 24) AS w FROM events GROUP BY 1)
SELECT batch, CAST(d AS DATE) <> CAST((SELECT max(ts) FROM events) AS DATE) AS daily_due, epoch_us((SELECT max(ts) FROM events)) - epoch_us(w) >= 604800000000 AS weekly_due FROM w""")
def weekly_due(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    rows = e.select(F.col("event_type").alias("batch"), F.lit("daily").alias("granularity"), F.col("ts").alias("recorded_at"))
    rows = rows.union(e.filter(F.dayofmonth("ts") <= 24).select("event_type", F.lit("weekly"), "ts"))
    return t.due(rows, now)


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 7 AS INTEGER) AS lane FROM events")
def lanes_round_robin(spark, sf_dir):
    return r.lanes(read(spark, sf_dir, "events"), 7, "ts", "event_id").select("event_id", "lane")


@query(f"""WITH {CALIBRATED}, a AS (SELECT entity_id, row_number() OVER (ORDER BY total DESC, entity_id)::INTEGER AS rank_base FROM entities), b AS (SELECT entity_id, row_number() OVER (ORDER BY final DESC, entity_id)::INTEGER AS rank_other FROM calibrated)
SELECT entity_id, rank_other, rank_base, rank_base - rank_other AS move FROM b LEFT JOIN a USING (entity_id)""")
def experiment_movers(spark, sf_dir):
    e = entities(spark, sf_dir)
    return r.movers(e.select("entity_id", F.col("total").alias("score")), s.calibrate(e).select("entity_id", F.col("final").alias("score")), "entity_id", "score")


@query(f"""WITH {BY_PLATFORM_D}, x AS (SELECT *, CASE platform WHEN 'x' THEN 0.1 WHEN 'instagram' THEN 0.1 WHEN 'github' THEN 0.5 WHEN 'linkedin' THEN 0.3 END::DOUBLE AS w2 FROM by_platform
), e AS (SELECT entity_id, count(*) AS n_platforms, sum(n) AS n_evidence, floor(sum(platform_score * w2) / sum(w2) * (0.85::DOUBLE + 0.15::DOUBLE * sqrt(count(*) / 4.0::DOUBLE)) + 0.5) AS total FROM x WHERE w2 IS NOT NULL GROUP BY 1
), h AS (SELECT *, total * (0.72::DOUBLE + 0.28::DOUBLE * least(1, sqrt(n_evidence / 5.0::DOUBLE))) AS held FROM e), g AS (SELECT min(held) AS low, max(held) AS high FROM h)
SELECT entity_id, n_platforms, floor((0.82::DOUBLE * held + 0.18::DOUBLE * (held - low) / (high - low) * 100) * 100 + 0.5) / 100 AS experiment FROM h, g""")
def experiment_diagnostics(spark, sf_dir):
    return s.experiment_scores(s.platform_scores(scored(spark, sf_dir), view_heavy=False), {"x": 0.1, "instagram": 0.1, "github": 0.5, "linkedin": 0.3})


@query("""SELECT event_id, least(100, greatest(0, floor(18 * ln(1 + value) + 0.5)))::DOUBLE AS seed, least(100, greatest(1, floor(100 * ln(1 + value * 2.5::DOUBLE) / ln(1 + 5000.0::DOUBLE) + 0.5)))::DOUBLE AS saturated FROM events""")
def seed_scores(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", s.seed_score(F.col("value")).alias("seed"), s.saturation_score(F.col("value"), 2.5, 5000.0).alias("saturated"))
