"""Queries over the planning operators, and scores of founders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as x
from tidemark.functions.num import jround
from tidemark.operators import attribution as a, dedupe as d, graph as g, media as m, planning as p, ranking as r, reports, scoring as s
from tidemark.plans import relations
from tidemark.plans.adapters import read
from tidemark.plans.registry import registry
from tidemark.sources import landed

QUERIES, ORACLE, query = registry()

PATTERNS = {"instagram": ["{name} site:instagram.com", '"{name}" Instagram', "{name} reels", "{name} reels"], "x": ['"{name}" x.com', "{name} site:x.com", "{domain} x"], "web": ["{name} {domain}"]}
#: Suppliers as entities; few of their lineitems count as scored evidence; events as attempts with a pattern.
PLAN = """e AS (SELECT s_suppkey AS entity_id, s_name AS name, 's' || s_suppkey || '.io' AS domain, n_name AS industry, CASE WHEN s_suppkey % 3 = 0 THEN 'Video for teams' ELSE 'Ledgers' END AS tagline, s_suppkey % 4 = 0 AS on_x FROM supplier JOIN nation ON n_nationkey = s_nationkey
), v AS (SELECT l_suppkey AS entity_id, CASE l_returnflag WHEN 'A' THEN 'instagram' WHEN 'N' THEN 'x' ELSE 'web' END AS platform, count(*) AS n, bool_or(l_quantity = 50 AND l_discount >= 0.09) AS scored FROM lineitem WHERE l_linenumber = 7 OR l_quantity = 50 GROUP BY 1, 2
), g AS (SELECT * FROM (VALUES ('instagram', 0, '{name} site:instagram.com'), ('instagram', 1, '"{name}" Instagram'), ('instagram', 2, '{name} reels'), ('x', 0, '"{name}" x.com'), ('x', 1, '{name} site:x.com'), ('x', 2, '{domain} x'), ('web', 0, '{name} {domain}')) t(platform, place, pattern)
), a AS (SELECT CASE WHEN event_id % 5 < 3 THEN 'instagram' ELSE 'x' END AS platform, ['{name} site:instagram.com', '"{name}" Instagram', '{name} reels', '"{name}" x.com', '{domain} x'][event_id % 5 + 1] AS pattern, value > 20 + event_id % 5 * 7 AND event_type <> 'error' AS useful FROM events
), k AS (SELECT platform, pattern, (count(*) FILTER (useful) + 1.0::DOUBLE) / (count(*) + 2) AS share, count(*) AS n, count(*) FILTER (useful) AS n_useful FROM a GROUP BY 1, 2)"""


def attempts(spark, sf_dir):
    i = F.col("event_id") % 5
    names = F.array(*map(F.lit, ["{name} site:instagram.com", '"{name}" Instagram', "{name} reels", '"{name}" x.com', "{domain} x"]))
    return read(spark, sf_dir, "events").select(F.when(i < 3, "instagram").otherwise("x").alias("platform"), F.get(names, i.cast("int")).alias("pattern"), ((F.col("value") > 20 + i * 7) & (F.col("event_type") != "error")).alias("useful"))


@query(f"WITH {PLAN} SELECT platform, pattern, n, n_useful, floor(share * 1e6 + 0.5) / 1e6 AS share FROM k")
def learned_patterns(spark, sf_dir):
    return p.learned(attempts(spark, sf_dir)).withColumn("share", jround(F.col("share"), 6))


@query(f"""WITH {PLAN}, o AS (SELECT e.*, g.platform, list(replace(replace(g.pattern, '{{name}}', e.name), '{{domain}}', e.domain) ORDER BY coalesce(share, 0.5) DESC, place) AS q FROM e, g LEFT JOIN k ON k.platform = g.platform AND k.pattern = g.pattern GROUP BY ALL)
SELECT o.entity_id, o.platform, CASE WHEN (o.platform = 'instagram' AND tagline LIKE 'Video%') OR (o.platform = 'x' AND on_x) THEN 'high' ELSE 'normal' END AS priority, coalesce(v.n, 0) AS n_current, o.platform || ':' || industry || ':b2b' AS reuse_key, array_to_string(q, '|') AS queries
FROM o LEFT JOIN v ON v.entity_id = o.entity_id AND v.platform = o.platform WHERE NOT coalesce(scored, false)""")
def discovery_plan(spark, sf_dir):
    n = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    entities = n.select(
        k.alias("entity_id"), F.col("s_name").alias("name"), F.concat(F.lit("s"), k, F.lit(".io")).alias("domain"), F.col("n_name").alias("industry"), F.lit("b2b").alias("model"), F.when(k % 3 == 0, "Video for teams").otherwise("Ledgers").alias("tagline"),
        F.lit(None).cast("string").alias("description"), F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("accounts"),
    )
    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber = 7 OR l_quantity = 50")
    platform = F.when(F.col("l_returnflag") == "A", "instagram").when(F.col("l_returnflag") == "N", "x").otherwise("web")
    evidence = rows.select(F.col("l_suppkey").alias("entity_id"), platform.alias("platform"), F.when((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.09), 1.0).otherwise(0.0).alias("contribution"))
    out = p.plan(entities, PATTERNS, evidence, attempts(spark, sf_dir))
    return out.withColumn("queries", F.array_join("queries", "|"))


#: Parts as entities, whose names and first labels many share; customers as candidates for them.
HANDLES = """e AS (SELECT p_partkey AS entity_id, p_name AS name, replace(p_name, ' ', '-') || p_size AS slug, replace(p_name, ' ', '') || p_partkey % 7 AS label, CASE WHEN p_partkey % 2 = 0 THEN 'io' ELSE 'k' || p_partkey END AS tld FROM part
), f AS (SELECT entity_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n, regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS s, label AS l, label || tld AS h FROM e
), each AS (SELECT DISTINCT entity_id, unnest([n, s, l, h]) AS form FROM f), o AS (SELECT form, count(*) AS owners FROM each GROUP BY 1
), c AS (SELECT c_custkey, f.*, CASE c_custkey % 5 WHEN 0 THEN h WHEN 1 THEN l WHEN 2 THEN s WHEN 3 THEN n ELSE 'nobody' || c_custkey END AS handle, c_custkey % 11 = 0 AS no FROM customer JOIN f ON entity_id = c_custkey % (SELECT count(*) FROM part) + 1)"""


@query(f"""WITH {HANDLES} SELECT c_custkey, entity_id, handle = h AND length(h) >= 6 AS exact_full_host, handle = l AND length(l) >= 5 AS exact_host, handle = s AND length(s) >= 7 AS exact_slug, handle = n AND length(n) >= 8 AS exact_name,
  length(n) <= 5 OR coalesce(owners, 0) > (handle IN (n, s, l, h))::INTEGER AS ambiguous, handle = h AND length(h) >= 6 AND NOT (length(n) <= 5 OR owners > 1) AS verified, CASE WHEN no THEN 'rejected' ELSE 'needs_review' END AS review_state FROM c LEFT JOIN o ON form = handle""")
def handle_candidates(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), (F.col("p_partkey") % 7).cast("string"))
    tld = F.when(F.col("p_partkey") % 2 == 0, "io").otherwise(F.concat(F.lit("k"), "p_partkey"))
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string"))
    named = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), slug.alias("slug"), F.concat(F.lit("https://www."), label, F.lit("."), tld, F.lit("/home")).alias("website"), F.concat(label, F.lit("."), tld).alias("h"), label.alias("l"))
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k, (k % part.count() + 1).alias("entity_id")).join(named, "entity_id")
    handle = F.when(k % 5 == 0, F.col("h")).when(k % 5 == 1, F.col("l")).when(k % 5 == 2, F.col("slug")).when(k % 5 == 3, F.col("name")).otherwise(F.concat(F.lit("nobody"), k))
    c = c.select("c_custkey", "entity_id", handle.alias("handle"), F.concat(F.lit("https://instagram.com/u"), k).alias("url"))
    out = p.handle_candidates(c, named.select("entity_id", "name", "slug", "website"), c.filter(k % 11 == 0))
    return out.drop("handle", "url")


@query("SELECT event_id AS id, CASE WHEN value > 100 THEN user_id + 1000000 WHEN event_type <> 'error' THEN user_id ELSE -1 END AS entity_id FROM events")
def evidence_owners(spark, sf_dir):
    """Users list their events but errors, and a second node, which comes later, some of them again."""
    e = read(spark, sf_dir, "events")
    first = e.filter("event_type <> 'error'").groupBy(F.col("user_id").alias("entity_id")).agg(F.collect_list("event_id").alias("evidence_ids")).withColumn("ordinal", F.lit(1))
    later = e.filter("value > 100").groupBy((F.col("user_id") + 1000000).alias("entity_id")).agg(F.collect_list("event_id").alias("evidence_ids")).withColumn("ordinal", F.lit(2))
    return p.owned(first.unionByName(later), e.select(F.col("event_id").alias("id"))).withColumn("entity_id", F.coalesce("entity_id", F.lit(-1)))


@query("""WITH l AS (SELECT user_id, 'https://x.com/u' || event_id % 23 AS url, event_id, event_type FROM events WHERE event_id % 6 > 1), o AS (SELECT user_id, url, arg_max(event_type, event_id) AS kind, min(event_id) AS place FROM l GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n FROM o) SELECT user_id, url, kind FROM k WHERE n <= 8""")
def social_candidates(spark, sf_dir):
    i = F.col("event_id")
    url = F.when(i % 6 == 0, "").when(i % 6 == 1, "https://x.com/intent/post").otherwise(F.concat(F.lit("https://x.com/u"), i % 23))
    links = read(spark, sf_dir, "events").select("user_id", F.lit("x").alias("platform"), url.alias("url"), i.alias("ordinal"), F.col("event_type").alias("kind"))
    return p.social_candidates(links, ["user_id"]).select("user_id", "url", "kind")


@query("""WITH l AS (SELECT user_id, 'https://www.producthunt.com/posts/p' || event_id % 9 AS url, event_id FROM events WHERE event_id % 4 <> 3) SELECT user_id, url, max(event_id) AS ordinal, min(event_id) AS place FROM l GROUP BY 1, 2""")
def launch_links(spark, sf_dir):
    """Links straight to a page, by way of a search page, and to reviews of it."""
    i, page = F.col("event_id"), F.concat(F.lit("www.producthunt.com/posts/p"), F.col("event_id") % 9)
    url = F.when(i % 4 == 0, F.concat(F.lit("https://"), page, F.lit("?ref=a#b"))).when(i % 4 == 1, F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(F.concat(F.lit("https://"), page, F.lit("?x=1"))), F.lit("&rut=1")))
    url = url.when(i % 4 == 2, F.concat(F.lit("//"), page)).otherwise(F.concat(F.lit("https://"), page, F.lit("/reviews")))
    links = read(spark, sf_dir, "events").select("user_id", url.alias("url"), i.alias("ordinal"))
    return p.launch_links(links, ["user_id"])


FOUNDERS = """r AS (SELECT user_id AS entity_id, CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'instagram' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'linkedin' ELSE 'web' END AS platform, avg(value) AS score, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)"""


def founder_platforms(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    platform = F.when(F.col("event_type") == "click", "x").when(F.col("event_type") == "view", "instagram").when(F.col("event_type") == "purchase", "github").when(F.col("event_type") == "signup", "linkedin").otherwise("web")
    return e.groupBy(F.col("user_id").alias("entity_id"), platform.alias("platform")).agg(F.avg("value").alias("score"), F.min("event_id").alias("ordinal"))


@query(f"""WITH {FOUNDERS} SELECT entity_id, coalesce(arg_max(platform, (score * w, -first)) FILTER (score * w > 0), arg_max(platform, (score, -first))) AS platform
FROM (SELECT *, CASE platform WHEN 'x' THEN 0.3 WHEN 'github' THEN 0.2 ELSE 0 END::DOUBLE AS w FROM r) GROUP BY 1""")
def top_platforms(spark, sf_dir):
    return s.top_platform(founder_platforms(spark, sf_dir), {"x": 0.3, "github": 0.2})


# Audits after the fact, and counters.

FLAGS = """f AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'youtube' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'reddit' ELSE 'web' END AS platform, value - 5 AS contribution, CASE WHEN event_id % 19 = 0 THEN 'Attribution guard: low risk' WHEN event_id % 13 = 0 THEN 'a repost' END AS why,
  event_id % 11 <> 0 AS resolved, event_id % 3 = 0 AS own, event_id % 5 = 0 AS verified, event_id % 4 = 0 AS conflict FROM events
), o AS (SELECT *, NOT own AND NOT verified AND contribution > 0 AND coalesce(why, '') NOT LIKE '%repost%' AS bare FROM f
), d AS (SELECT *, CASE WHEN why LIKE 'Attribution%' THEN 'guarded' WHEN NOT resolved THEN 'unresolved' WHEN platform = 'github' AND NOT own AND NOT verified THEN 'unknown_repository' WHEN conflict AND NOT own THEN 'other_entity' WHEN bare AND platform IN ('youtube', 'reddit') THEN 'no_signal' WHEN bare THEN 'weak_signal' WHEN verified THEN 'verified_account' ELSE 'visible_signal' END AS reason FROM o
), r AS (SELECT *, CASE WHEN reason IN ('unresolved', 'unknown_repository', 'other_entity', 'no_signal') THEN 'high' WHEN reason = 'weak_signal' THEN 'medium' ELSE 'low' END AS risk FROM d)"""


def audited(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    platform = F.when(t == "click", "x").when(t == "view", "youtube").when(t == "purchase", "github").when(t == "signup", "reddit").otherwise("web")
    why = F.when(i % 19 == 0, "Attribution guard: low risk").when(i % 13 == 0, "a repost")
    none = F.lit(None).cast("string")
    return a.offline_audit(read(spark, sf_dir, "events").select(
        "event_id", "user_id", platform.alias("platform"), (F.col("value") - 5).alias("contribution"), why.alias("why"), none.alias("match_reason"), none.alias("raw"), (i % 11 != 0).alias("resolved"), (i % 3 == 0).alias("own_signal"), (i % 5 == 0).alias("verified_account"), (i % 4 == 0).alias("conflict"),
    ))


@query(f"WITH {FLAGS} SELECT event_id, risk, reason FROM r")
def offline_attribution(spark, sf_dir):
    return audited(spark, sf_dir).select("event_id", "risk", "reason")


@query(f"WITH {FLAGS} SELECT user_id, risk, count(*) AS n FROM r GROUP BY 1, 2")
def risk_by_entity(spark, sf_dir):
    return audited(spark, sf_dir).groupBy("user_id", "risk").agg(F.count("*").alias("n"))


PICTURED = """v AS (SELECT event_type AS platform, user_id AS entity_id, value - 20 AS score, CASE event_id % 5 WHEN 0 THEN 'https://a/p.png' WHEN 1 THEN '/placeholder.png' WHEN 2 THEN '' WHEN 3 THEN 'https://a/x.svg' END AS picture, CASE event_id % 4 WHEN 0 THEN 'stored' WHEN 1 THEN 'video' WHEN 2 THEN 'media' END AS origin FROM events)"""


def pictured(spark, sf_dir):
    i = F.col("event_id")
    picture = F.when(i % 5 == 0, "https://a/p.png").when(i % 5 == 1, "/placeholder.png").when(i % 5 == 2, "").when(i % 5 == 3, "https://a/x.svg")
    origin = F.when(i % 4 == 0, "stored").when(i % 4 == 1, "video").when(i % 4 == 2, "media")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("platform"), F.col("user_id").alias("entity_id"), (F.col("value") - 20).alias("score"), picture.alias("picture"), origin.alias("origin"))


@query(f"""WITH {PICTURED} SELECT platform, count(*) AS n_rows, count(*) FILTER (score > 0) AS n_scored, count(DISTINCT entity_id) AS n_entities, count(DISTINCT entity_id) FILTER (score > 0) AS n_scored_entities,
  count(*) FILTER (picture <> '') AS n_pictures, count(*) FILTER (picture = 'https://a/p.png') AS n_real_pictures FROM v GROUP BY 1""")
def evidence_counters(spark, sf_dir):
    return m.evidence_counters(pictured(spark, sf_dir))


@query(f"WITH {PICTURED} SELECT platform, coalesce(origin, 'none') AS origin, count(*) AS n FROM v GROUP BY 1, 2")
def picture_origins(spark, sf_dir):
    return m.picture_origins(pictured(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS company_profiles, (SELECT count(*) FROM supplier WHERE s_acctbal > 5000) AS company_overrides, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS founder_profiles, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS founder_overrides,
  (SELECT count(*) FROM orders) AS candidates, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS candidates_needs_review, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS candidates_rejected, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS candidates_failed,
  (SELECT count(*) FROM events) AS attempts, (SELECT count(*) FROM events WHERE event_type = 'view') AS attempts_no_results, (SELECT count(*) FROM events WHERE event_type = 'error') AS attempts_failed""")
def profile_counters(spark, sf_dir):
    """Suppliers as companies, customers as founders, orders as candidates, events as attempts."""
    url = lambda when: F.map_from_arrays(F.array(F.lit("instagram")), F.array(F.when(when, "https://instagram.com/a").otherwise("")))
    companies = read(spark, sf_dir, "supplier").select(url(F.col("s_suppkey") % 3 == 0).alias("links"), url(F.col("s_acctbal") > 5000).alias("overrides"))
    founders = read(spark, sf_dir, "customer").select(url(F.col("c_custkey") % 4 == 0).alias("links"), url(F.col("c_acctbal") > 9000).alias("overrides"))
    state = F.when(F.col("o_orderstatus") == "O", "needs_review").when(F.col("o_orderstatus") == "P", "rejected").otherwise("failed")
    status = F.when(F.col("event_type") == "view", "no_results").when(F.col("event_type") == "error", "failed").otherwise("found")
    return m.profile_counters(companies, founders, read(spark, sf_dir, "orders").select(state.alias("review_state")), read(spark, sf_dir, "events").select(status.alias("status")), "instagram")


@query("""WITH b AS (SELECT user_id, floor(avg(value) * 100 + 0.5) AS score FROM events WHERE event_id % 3 > 0 GROUP BY 1), o AS (SELECT user_id, floor(avg(value) * 100 + 0.5) AS score FROM events GROUP BY 1
), x AS (SELECT o.user_id, row_number() OVER (ORDER BY o.score DESC, o.user_id) AS rank_other FROM o), y AS (SELECT user_id, row_number() OVER (ORDER BY score DESC, user_id) AS rank_base FROM b
), m AS (SELECT user_id, rank_other::INTEGER AS rank_other, coalesce(rank_base, 999)::INTEGER AS rank_base FROM x LEFT JOIN y USING (user_id)) SELECT *, rank_base - rank_other AS move FROM m ORDER BY abs(rank_base - rank_other) DESC, rank_other LIMIT 25""")
def biggest_movers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    score = lambda df: s.mean_in_order(df, "user_id", "value", "event_id").withColumn("score", jround(F.col("mean") * 100))
    return r.biggest_movers(score(e.filter("event_id % 3 > 0")), score(e), "user_id", "score")


# Views, coverage and small rules.


@query(f"WITH {relations.EDGES} SELECT source, target, weight FROM edges WHERE weight >= 0.34")
def clear_view_edges(spark, sf_dir):
    """The view without the weaker edges."""
    nodes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("i").alias("industry"), F.lit("p").alias("partner"), F.lit("b2b").alias("model"), F.array(F.lit("x")).alias("platforms"), F.col("c_acctbal").alias("score"))
    none = spark.createDataFrame([], "entity_id long, platform string")
    edges = lambda kept: g.similarity_edges(relations.items(spark, sf_dir).join(kept.select("id"), "id", "left_semi"), 0.34)
    return g.query(nodes, edges, none, none, g.Filters(), least_weight=0.34).edges


@query(f"""WITH {relations.EDGES.replace("0.75::DOUBLE", "0.72::DOUBLE").replace("0.25::DOUBLE", "0.28::DOUBLE").replace("* 100 + 0.5) / 100", "* 1000 + 0.5) / 1000")} SELECT source, target, weight FROM edges WHERE weight >= 0.28""")
def demo_similarity_edges(spark, sf_dir):
    return g.similarity_edges(relations.items(spark, sf_dir), 0.28, 0.72, 0.28, digits=3)


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'ring') OR p_name = 'ring'")
def graph_nodes_by_text(spark, sf_dir):
    """Nodes whose label has the text; nearer misses count less than what the view asks for."""
    return relations.nodes(spark, sf_dir).filter(g.matches(g.Filters(text="ring"), least_match=64.0)).select("id")


REDACTED = "t"
for pattern, by in (*x.SECRETS[:-1], *x.COOKIES, x.SECRETS[-1]):
    options = "'gi'" if pattern.startswith("(?i)") else "'g'"
    REDACTED = f"regexp_replace({REDACTED}, '{pattern.removeprefix('(?i)')}', '{by.replace('$1', chr(92) + '1')}', {options})"


@query(f"""WITH d AS (SELECT doc_id, text || ' JSESSIONID="ajax:' || doc_id || '" li_at=AQED' || doc_id || 'abcdefghijklmnop;' AS t FROM documents) SELECT doc_id, md5({REDACTED}) AS digest, contains({REDACTED}, 'li_at=[redacted-cookie]') AS hidden FROM d""")
def redact_cookies(spark, sf_dir):
    """Documents as pages that were read while logged in."""
    page = F.concat("text", F.lit(' JSESSIONID="ajax:'), "doc_id", F.lit('" li_at=AQED'), "doc_id", F.lit("abcdefghijklmnop;"))
    clean = x.redact(page, cookies=True)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), F.contains(clean, F.lit("li_at=[redacted-cookie]")).alias("hidden"))


@query("""WITH m AS (SELECT doc_id, regexp_extract(replace(text, ',', ''), '([0-9.]+)[ \t\n\r\f\v]*([KkMmBb])?', 1) AS d, lower(regexp_extract(replace(text, ',', ''), '([0-9.]+)[ \t\n\r\f\v]*([KkMmBb])?', 2)) AS u FROM documents
), n AS (SELECT doc_id, CASE WHEN length(d) <= 15 THEN TRY_CAST(CASE WHEN regexp_full_match(d, '[0-9]+[.]?|[0-9]*[.][0-9]{1,6}') THEN d END AS DOUBLE) END AS d, CASE u WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS t FROM m) SELECT doc_id, coalesce(CAST(floor(d * t + 0.5) AS BIGINT), -1) AS n FROM n""")
def first_compact_number(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(x.compact_number_in(F.col("text")), F.lit(-1)).alias("n"))


@query("SELECT event_type, coalesce(floor(sum(CASE WHEN user_id % 5 > 0 THEN value * (user_id % 5) END) / sum(CASE WHEN user_id % 5 > 0 THEN user_id % 5 END) * 1e6 + 0.5) / 1e6, -1) AS average FROM events GROUP BY 1")
def weighted_average_values(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(jround(s.weighted_average(F.col("value"), F.col("user_id") % 5, -1.0), 6).alias("average"))


@query("""WITH a AS (SELECT l_suppkey AS entity_id, l_partkey % 50 AS account, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT entity_id, account, ordinal FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25 AND l_suppkey = entity_id AND l_partkey % 50 = account)""")
def own_accounts(spark, sf_dir):
    """Accounts of suppliers out of lineitems, without those of their members."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_partkey") % 50).alias("account"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), "l_returnflag", "l_quantity")
    return d.own_accounts(rows.filter("l_returnflag = 'A'").select("entity_id", "account", "ordinal"), rows.filter("l_returnflag = 'R' AND l_quantity > 25"), ["entity_id", "account"])


@query("""SELECT c_custkey, 'x' AS platform, 'https://twitter.com/U' || c_custkey || '/media' AS url, 'u' || c_custkey AS handle FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'linkedin', 'https://www.linkedin.com/in/n' || c_custkey || '/', 'n' || c_custkey FROM customer
UNION ALL SELECT c_custkey, 'web', 'https://c' || c_custkey || '.example/about', 'about' FROM customer""")
def platform_links(spark, sf_dir):
    """Links of customers by platform; some lie on another platform's host, or are no addresses."""
    k = F.col("c_custkey")
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    links = F.map_from_arrays(F.array(*map(F.lit, ("x", "linkedin", "instagram", "github", "web"))), F.array(
        F.when(k % 3 == 0, at("https://twitter.com/U", k, "/media")).when(k % 3 == 1, at("https://x.com.example/u", k)).otherwise(at("https://www.linkedin.com/in/u", k)), at("https://www.linkedin.com/in/n", k, "/"), F.lit(""), F.lit("no address"), at("https://c", k, ".example/about"),
    ))
    return landed.platform_links(read(spark, sf_dir, "customer").select("c_custkey", links.alias("links")), "c_custkey", "links")


TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


@query("""SELECT t AS platform, count(event_id) AS n_rows, count(*) FILTER (value > 20) AS n_scored, count(DISTINCT user_id) FILTER (value > 20) AS n_entities, count(DISTINCT user_id) AS n_with_rows, count(*) FILTER (event_id % 7 = 0) AS n_review
FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS t) LEFT JOIN events ON event_type = t GROUP BY 1""")
def platform_coverage_with_reviews(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("platform"), F.col("user_id").alias("entity_id"), (F.col("value") - 20).alias("score"))
    return reports.coverage_with_reviews(rows, e.filter("event_id % 7 = 0").select(F.col("event_type").alias("platform")), TYPES)


@query("""WITH v AS (SELECT user_id, event_type, value > 60 AS scored FROM events), u AS (SELECT DISTINCT user_id FROM events UNION SELECT 1000000)
SELECT u.user_id AS entity_id, count(event_type) AS n_rows, count(*) FILTER (scored) AS n_scored, count(*) FILTER (scored AND event_type <> 'view') AS n_scored_elsewhere, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS platforms,
  coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (scored), '') AS scored_platforms, array_to_string(list_filter(['signup', 'click', 'refund'], lambda p: NOT coalesce(list_contains(list(event_type) FILTER (scored), p), false)), ',') AS lacking FROM u LEFT JOIN v ON v.user_id = u.user_id GROUP BY 1""")
def entity_coverage(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("platform"), F.col("user_id").alias("entity_id"), F.when(F.col("value") > 60, 1).otherwise(0).alias("score"))
    entities = rows.select("entity_id").distinct().unionByName(spark.range(1_000_000, 1_000_001).select(F.col("id").alias("entity_id")))
    out = reports.entity_coverage(entities, rows, ["signup", "click", "refund"], code="view")
    return out.withColumns({c: F.array_join(c, ",") for c in ("platforms", "scored_platforms", "lacking")})
