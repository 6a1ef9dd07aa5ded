"""Queries over the audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import within_days
from tidemark.functions.num import jround
from tidemark.operators import audits as q, ranking as r
from tidemark.plans.adapters import evidence, read
from tidemark.plans.registry import registry

QUERIES, ORACLE, query = registry()


@query("""WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'instagram' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'linkedin' WHEN 'error' THEN 'web' END AS platform, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
), l AS (SELECT platform, 'views' AS metric, value FROM m UNION ALL SELECT platform, 'likes', k FROM m UNION ALL SELECT platform, 'stars', value FROM m)
SELECT platform, metric, CASE WHEN platform = 'github' AND metric = 'stars' THEN max(value) ELSE CAST(sum(CAST(value AS DECIMAL(24, 4))) AS DOUBLE) END AS total FROM l WHERE value IS NOT NULL GROUP BY 1, 2""")
def metric_totals(spark, sf_dir):
    return q.metric_totals(evidence(spark, sf_dir))


def checks() -> list[q.Check]:
    return [
        q.Check("empty_text", F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "high"), q.Check("length_differs", F.length("text") != F.col("n_chars"), "high"), q.Check("very_short", F.col("n_chars") < 100, "low", 500),
        q.Check("no_source", F.col("source").isNull(), "high"), q.Check("very_long", F.col("n_chars") > 20_000, "medium"), q.Check("has_address", F.contains("text", F.lit("@")), "medium"),
    ]


FOUND = """c AS (SELECT count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS a, count(*) FILTER (length(text) <> n_chars) AS b, count(*) FILTER (n_chars < 100) AS c, count(*) FILTER (source IS NULL) AS d, count(*) FILTER (n_chars > 20000) AS e, count(*) FILTER (contains(text, '@')) AS f FROM documents
), found AS (SELECT 'empty_text' AS "check", 'high' AS severity, a AS n, a > 0 AS failed FROM c UNION ALL SELECT 'length_differs', 'high', b, b > 0 FROM c UNION ALL SELECT 'very_short', 'low', c, c > 500 FROM c
  UNION ALL SELECT 'no_source', 'high', d, d > 0 FROM c UNION ALL SELECT 'very_long', 'medium', e, e > 0 FROM c UNION ALL SELECT 'has_address', 'medium', f, f > 0 FROM c)"""


@query(f"WITH {FOUND} SELECT * FROM found")
def quality_findings(spark, sf_dir):
    return q.findings(read(spark, sf_dir, "documents"), checks())


@query(f"WITH {FOUND} SELECT count(*) FILTER (failed AND severity = 'high') AS n_high, count(*) FILTER (failed AND severity = 'medium') AS n_medium, count(*) FILTER (failed AND severity = 'low') AS n_low, count(*) FILTER (failed AND severity = 'high') = 0 AS passed FROM found")
def quality_verdict(spark, sf_dir):
    return q.verdict(q.findings(read(spark, sf_dir, "documents"), checks()))


@query("""WITH v AS (SELECT p_type AS config, floor(avg(p_size) * 1000 + 0.5) / 1000 AS value FROM part GROUP BY 1), b AS (SELECT max(value) AS best, max(value) FILTER (config = 'PROMO') AS own, arg_max(config, value) AS c FROM v)
SELECT CASE WHEN own >= best - 0.5 THEN 'PROMO' ELSE c END AS config, CASE WHEN own >= best - 0.5 THEN own ELSE best END AS value FROM b""")
def config_choice(spark, sf_dir):
    quality = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("config")).agg(jround(F.avg("p_size"), 3).alias("value"))
    return q.choose(quality, "PROMO")


@query("SELECT event_type AS platform, CASE WHEN value > 100 THEN 'done' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def checkpoint_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return q.task_summary(e.select(F.concat_ws(":", "event_type", "user_id").alias("task_key"), F.when(F.col("value") > 100, "done").otherwise("failed").alias("status")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) * 1000 AS followers, CAST(l_linenumber AS BIGINT) AS posts, CAST(greatest(l_quantity * 1000, l_linenumber) AS BIGINT) AS largest FROM lineitem")
def metric_from_text(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("Profile\n"), F.floor("l_quantity").cast("string"), F.lit("K Followers and more\n"), F.col("l_linenumber").cast("string"), F.lit(" posts"))
    largest = q.largest_metric(F.concat(F.floor("l_quantity").cast("string"), F.lit("K")), F.col("l_linenumber").cast("string"), F.lit("none"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", q.metric_near(text, "followers").alias("followers"), q.metric_near(text, "posts").alias("posts"), largest.alias("largest"))


@query("""SELECT DISTINCT s_suppkey, unnest(['"' || s_name || '" github', s_name || ' site', '"' || s_name || '"']) AS query FROM supplier""")
def discovery_queries(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return q.search_queries(s, F.col("s_name"), F.lit(None).cast("string"), ['"{name}" github', "{name} site", '"{name}"', "{name} site", "{domain}"]).select("s_suppkey", "query")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events)
SELECT event_id, user_id, CASE WHEN user_id = 8 THEN props END AS props FROM k WHERE user_id <> 8 OR place <= 20""")
def trimmed_evidence(spark, sf_dir):
    return q.trim_detail(read(spark, sf_dir, "events"), "user_id", ["props"], F.lit(8), 20, F.desc("value"), "event_id").select("event_id", "user_id", "props")


@query("""WITH m AS (SELECT user_id, count(*)::DOUBLE AS n, max(value) AS best, count(DISTINCT event_type)::DOUBLE AS kinds FROM events WHERE user_id IN (8, 46) GROUP BY 1
), l AS (SELECT user_id, 'n' AS measure, n AS value FROM m UNION ALL SELECT user_id, 'best', best FROM m UNION ALL SELECT user_id, 'kinds', kinds FROM m)
SELECT measure, max(value) FILTER (user_id = 8) AS one, max(value) FILTER (user_id = 46) AS other, coalesce(max(value) FILTER (user_id = 8), 0) - coalesce(max(value) FILTER (user_id = 46), 0) AS difference FROM l GROUP BY 1""")
def entity_comparison(spark, sf_dir):
    return q.compare(read(spark, sf_dir, "events"), "user_id", 8, 46, {"n": F.count("*"), "best": F.max("value"), "kinds": F.countDistinct("event_type")})


@query("SELECT event_id, event_type, value FROM events ORDER BY coalesce(value, 0) DESC, event_id LIMIT 50")
def sorted_feed(spark, sf_dir):
    return r.top(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), 50, F.coalesce("value", F.lit(0.0)).desc(), "event_id")


@query("""SELECT event_type, count(*) FILTER (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 7 * 86400000000) AS n_recent, count(*) AS n FROM events GROUP BY 1""")
def recent_activity(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    as_of = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy("event_type").agg(F.count_if(within_days(F.col("ts"), as_of, 7)).alias("n_recent"), F.count("*").alias("n"))
