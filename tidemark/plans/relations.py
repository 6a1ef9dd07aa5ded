"""Queries over the graph, duplicate, attribution and report operators, and over texts and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as x, urls as u
from tidemark.functions.match import similarity
from tidemark.functions.num import jround
from tidemark.operators import attribution as a, dedupe as d, graph as g, reports as p
from tidemark.plans.adapters import read
from tidemark.plans.registry import registry

QUERIES, ORACLE, query = registry()


# Nodes and edges.

NODES = "nodes AS (SELECT p_partkey AS id, p_name AS label, p_brand AS partner, p_type AS industry, floor(p_size * 2.0::DOUBLE + 0.5) AS score FROM part)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("partner"), F.col("p_type").alias("industry"), F.lit("b2b").alias("model"), F.array("p_type").alias("platforms"), jround(F.col("p_size") * 2.0).alias("score"))


FILTERS = g.Filters(min_score=20, industries=("ECONOMY", "PROMO"), partners=("Brand#2", "Brand#4", "Brand#17"))
SEEN = NODES + ", seen AS (SELECT * FROM nodes WHERE score >= 20 AND industry IN ('ECONOMY', 'PROMO') AND partner IN ('Brand#2', 'Brand#4', 'Brand#17'))"


def seen(spark, sf_dir):
    return nodes(spark, sf_dir).filter(g.matches(FILTERS))


@query(f"WITH {SEEN} SELECT id, label, score FROM seen")
def filtered_graph_nodes(spark, sf_dir):
    return seen(spark, sf_dir).select("id", "label", "score")


@query(f"WITH {SEEN} SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT id FROM seen)")
def visible_edges(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return g.visible(pairs, seen(spark, sf_dir), "l_partkey").distinct()


@query(f"WITH {SEEN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT id FROM seen) AND l_quantity > 40")
def visible_evidence(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return g.visible(rows, seen(spark, sf_dir), "l_partkey")


@query("""WITH c AS (SELECT p_partkey, p_brand, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey) AS source FROM part)
SELECT source, p_partkey AS target, p_brand AS "group", 0.86::DOUBLE AS weight FROM c WHERE source IS NOT NULL""")
def partner_chain_edges(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return g.chain_edges(part, "p_brand", F.desc("p_retailprice"), "p_name", "id")


#: Customers as entities: tags are the nation, which many share, and a part of a segment; tokens the digits of the balance.
ITEMS = """items AS (SELECT c_custkey AS id, ['n' || c_nationkey, 's' || c_mktsegment || (c_custkey % 40)] AS tags, list_distinct(string_split(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), '')) AS tokens FROM customer)"""
EDGES = ITEMS + """, pairs AS (SELECT a.id AS source, b.id AS target, len(list_intersect(a.tags, b.tags)) AS ti, len(list_distinct(list_concat(a.tags, b.tags))) AS tu, len(list_intersect(a.tokens, b.tokens)) AS ki, len(list_distinct(list_concat(a.tokens, b.tokens))) AS ku
  FROM items a JOIN items b ON a.id < b.id
), edges AS (SELECT source, target, floor((0.75::DOUBLE * CASE WHEN tu = 0 THEN 0 ELSE ti::DOUBLE / tu END + 0.25::DOUBLE * CASE WHEN ku = 0 THEN 0 ELSE ki::DOUBLE / ku END) * 100 + 0.5) / 100 AS weight FROM pairs)"""


def items(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    tags = F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("s"), "c_mktsegment", (F.col("c_custkey") % 40).cast("string")))
    digits = F.array_distinct(F.split(F.floor("c_acctbal").cast("string"), ""))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ordinal"), tags.alias("tags"), digits.alias("tokens"))


@query(f"WITH {EDGES} SELECT source, target, weight FROM edges WHERE weight >= 0.28")
def tag_similarity_edges(spark, sf_dir):
    return g.similarity_edges(items(spark, sf_dir))


@query()
def greedy_degree_capped_edges(spark, sf_dir):
    return g.greedy_similar_edges(items(spark, sf_dir))


#: Parts as companies and founders, and a query with typing errors.
SEARCH = """WITH v AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'company' ELSE 'founder' END AS kind, p_size::DOUBLE AS score, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS v, 'smal rinng' AS q FROM part
), t AS (SELECT *, 1 - levenshtein(replace(q, ' ', ''), replace(v, ' ', ''))::DOUBLE / greatest(length(replace(q, ' ', '')), length(replace(v, ' ', ''))) AS whole, list_transform(['smal', 'rinng'], lambda a: list_max(list_transform(list_filter(string_split(v, ' '), lambda b: length(b) >= 3), lambda b: 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))))) AS best FROM v
), f AS (SELECT *, CASE WHEN whole >= 0.85 THEN 86 + floor(whole * 10 + 0.5) WHEN whole >= 0.78 THEN 66 + floor(whole * 18 + 0.5) WHEN list_min(best) >= 0.58 AND list_avg(best) >= 0.68 THEN 42 + floor(list_avg(best) * 24 + 0.5) ELSE 0 END AS fuzzy,
    CASE WHEN v = q THEN 100 WHEN starts_with(v, q) THEN 82 WHEN contains(v, q) THEN 64 WHEN contains(v, 'smal') AND contains(v, 'rinng') THEN 50 ELSE 0 END AS exact FROM t
), m AS (SELECT id, label, kind, greatest(fuzzy, exact) AS m, score FROM f)
SELECT id, label, kind, floor((m + score / CASE kind WHEN 'company' THEN 500.0::DOUBLE ELSE 650.0::DOUBLE END) * 10000 + 0.5) / 10000 AS match FROM m WHERE m > 0 ORDER BY match DESC, label, id LIMIT 14"""


@query(SEARCH)
def fuzzy_search(spark, sf_dir):
    return g.search(labels(spark, sf_dir), "smal rinng", 14)


@query(SEARCH)
def indexed_search(spark, sf_dir):
    return g.search(g.search_index(labels(spark, sf_dir)), "smal rinng", 14)


def labels(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 2 == 0, "company").otherwise("founder").alias("kind"), F.col("p_size").cast("double").alias("score"))


@query("SELECT c_custkey, levenshtein(c_mktsegment, 'BULIDING')::INTEGER AS edits, floor((1 - levenshtein(c_mktsegment, 'BULIDING')::DOUBLE / greatest(length(c_mktsegment), 8)) * 1e6 + 0.5) / 1e6 AS similarity FROM customer")
def edit_similarity(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.levenshtein("c_mktsegment", F.lit("BULIDING")).alias("edits"), jround(similarity(F.col("c_mktsegment"), F.lit("BULIDING")), 6).alias("similarity"))


# Duplicates.


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id) AS k FROM events) WHERE k = 1")
def dedupe_survivor(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return d.survivors(e, ["user_id", "event_type"], F.desc("ts"), F.desc("value"), ordinal="event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_ordinal FROM events GROUP BY 1")
def dedupe_last_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return d.last_wins(e.withColumn("ordinal", F.col("event_id")), ["user_id"]).select("user_id", "event_id", "event_type", "first_ordinal")


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def dedupe_merge_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("event_type"), "value")
    return d.merge_fields(e, ["user_id"], ["event_type"], ordinal="event_id")


STATES = """CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'needs_review' WHEN 'click' THEN 'no_results' ELSE 'rejected' END"""


@query(f"""WITH s AS (SELECT user_id, event_id, {STATES} AS state FROM events), r AS (SELECT *, CASE state WHEN 'rejected' THEN 6 WHEN 'verified' THEN 5 WHEN 'needs_review' THEN 4 WHEN 'failed' THEN 3 WHEN 'no_results' THEN 2 END AS k,
  lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s)
SELECT user_id, arg_max(state, k::BIGINT * 1000000000 + event_id) AS state, count(*) AS n_attempts, min(event_id) AS first_ordinal, max(event_id) AS last_ordinal, count(*) FILTER (state <> b) AS n_changes FROM r GROUP BY 1""")
def merge_discovery_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "signup", "needs_review").when(F.col("event_type") == "click", "no_results").otherwise("rejected")
    return d.merge_states(e.select("user_id", "event_id", state.alias("state")), ["user_id"], ordinal="event_id")


@query("SELECT text, count(*) AS n, count(DISTINCT source) AS n_owners FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1")
def cross_entity_duplicates(spark, sf_dir):
    return d.groups(read(spark, sf_dir, "documents").select("text", "source"), "text", "source").filter("n_owners > 1")


FINGERPRINT = """f AS (SELECT source, lang, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), 'https?://[^\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 2)[1:28], ' ') AS fingerprint FROM documents WHERE n_chars > 0)"""


@query(f"WITH {FINGERPRINT} SELECT fingerprint, count(*) AS n, count(DISTINCT source) AS n_owners, count(DISTINCT lang) AS n_platforms FROM f WHERE length(fingerprint) >= 28 GROUP BY 1 HAVING count(DISTINCT source) > 1 AND count(DISTINCT lang) <= 2")
def text_fingerprint_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("text", "source", "lang", F.col("n_chars").alias("score"))
    return d.near_duplicates(rows, "text", "source", "lang", "score")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def accounts_minus_founders(spark, sf_dir):
    founders = read(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return d.without(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), founders, ["s_nationkey"])


# URLs and texts.


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.host(F.col("url")).alias("host"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS h, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages
), k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|fbclid|gclid|igshid|mc_.*|ref|ref_src|s|t)$')), '&') AS kept FROM p)
SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM k""")
def canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1), '') AS handle FROM pages")
def handle_from_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", u.handle(F.lit("x"), F.col("url")).alias("handle"))


#: Pages renamed as posts of two platforms.
@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN nullif(regexp_extract(url, '/([0-9]+)', 1), '') ELSE nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') END AS post_id FROM pages""")
def post_id_from_url(spark, sf_dir):
    url = F.col("url")
    status = F.regexp_replace(url, "/([0-9]+)", "/status/$1")
    video = F.regexp_replace(url, "([?&])page=", "$1v=")
    even = F.col("page_id") % 2 == 0
    return read(spark, sf_dir, "pages").select("page_id", u.post_id(F.when(even, "x").otherwise("youtube"), F.when(even, status).otherwise(video)).alias("post_id"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^@', ''), 'https?://(www\\.)?', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS searchable FROM documents""")
def text_normal_forms(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", x.slug(F.col("text")).alias("slug"), x.searchable(F.col("text")).alias("searchable"))


@query("""SELECT c_custkey, CAST(CASE WHEN c_acctbal >= 1000 THEN floor(floor(c_acctbal / 1000 * 10 + 0.5) / 10 * 1000 + 0.5) WHEN c_acctbal >= 0 THEN floor(c_acctbal + 0.5) END AS BIGINT) AS n FROM customer WHERE c_acctbal >= 0""")
def compact_number(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return c.select("c_custkey", x.compact_number(x.compact_label(F.col("c_acctbal"))).alias("n"))


REDACTED = "text"
for pattern, by in x.SECRETS:
    options = "'gi'" if pattern.startswith("(?i)") else "'g'"
    REDACTED = f"regexp_replace({REDACTED}, '{pattern.removeprefix('(?i)')}', '{by.replace('$1', chr(92) + '1')}', {options})"


@query(f"SELECT doc_id, md5({REDACTED}) AS digest, {REDACTED} <> text AS changed FROM documents")
def redact_tokens(spark, sf_dir):
    clean = x.redact(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest FROM pages""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(x.readable_html(F.col("html"))).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 'jewel' WHEN contains(lower(p_name || ' ' || p_type), 'bolt') OR contains(lower(p_name || ' ' || p_type), 'widget') THEN 'hardware' WHEN contains(lower(p_name || ' ' || p_type), 'promo') THEN 'marketing' ELSE 'b2b' END AS class FROM part""")
def classifier_case(spark, sf_dir):
    classes = (("jewel", ("ring",)), ("hardware", ("bolt", "widget")), ("marketing", ("promo",)))
    return read(spark, sf_dir, "part").select("p_partkey", a.classify(F.concat_ws(" ", "p_name", "p_type"), classes).alias("class"))


# Attribution and identity.

PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://(www\\.)?', ' ', 'g'), '[_-]+', ' ', 'g'), '[^a-z0-9.]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {PLAIN.format("text")} AS t FROM documents), p AS (SELECT item_id AS phrase_id, {PLAIN.format("text")} AS p FROM benchmark)
SELECT doc_id, phrase_id FROM t JOIN p ON p <> '' AND contains(t, p) AND regexp_matches(t, '(^|[^a-z0-9])' || replace(p, '.', '\\.') || '([^a-z0-9]|$)')""")
def phrase_attribution(spark, sf_dir):
    phrases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return a.phrase_hits(read(spark, sf_dir, "documents"), phrases, "doc_id", "text")


@query("""WITH f AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'instagram' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'reddit' ELSE 'web' END AS platform, value AS contribution, CASE WHEN event_id % 17 = 0 THEN 'rejected' END AS held,
  event_id % 11 <> 0 AS resolved, event_id % 3 = 0 AS verified, event_id % 5 = 0 AS visible, event_id % 9 = 0 OR event_id % 5 = 0 AS own, event_id % 13 = 0 AS context, event_id % 7 = 0 AS quote, event_id % 4 = 0 AS conflict, event_id % 6 = 0 AS off FROM events
), g AS (SELECT *, CASE WHEN NOT resolved THEN 1 WHEN platform = 'web' THEN 2 WHEN platform = 'github' AND (verified OR own) THEN 2 WHEN platform = 'github' THEN 1 WHEN context THEN 3 WHEN platform = 'instagram' AND NOT verified THEN 1
  WHEN platform = 'x' AND quote AND NOT visible THEN 1 WHEN conflict AND NOT visible THEN 1 WHEN verified AND off AND NOT visible THEN 4 WHEN verified OR own THEN 2 WHEN platform = 'reddit' THEN 1 ELSE 4 END AS r FROM f)
SELECT event_id, CASE WHEN r IN (2, 3) THEN coalesce(held, 'verified') ELSE 'needs_review' END AS review_state, ['high', 'low', 'low', 'medium'][r] AS risk, CASE WHEN r = 2 THEN contribution ELSE 0 END AS guarded FROM g""")
def attribution_guard(spark, sf_dir):
    i = F.col("event_id")
    platform = F.when(F.col("event_type") == "click", "x").when(F.col("event_type") == "view", "instagram").when(F.col("event_type") == "purchase", "github").when(F.col("event_type") == "signup", "reddit").otherwise("web")
    rows = read(spark, sf_dir, "events").select(
        "event_id", platform.alias("platform"), F.col("value").alias("contribution"), F.when(i % 17 == 0, "rejected").alias("review_state"), (i % 11 != 0).alias("resolved"), (i % 3 == 0).alias("verified_account"),
        (i % 5 == 0).alias("visible_signal"), (i % 9 == 0).alias("own_signal"), (i % 13 == 0).alias("context_only"), (i % 7 == 0).alias("quote"), (i % 4 == 0).alias("conflict"), (i % 6 == 0).alias("off_topic"),
    )
    return a.guard(rows).select("event_id", "review_state", "risk", "guarded")


#: Suppliers as companies with a site, two accounts and a founder; events as posts attached to one of them.
POSTED = """co AS (SELECT s_suppkey AS c, 'alpha works ' || s_suppkey AS name, 'alphaworks' || s_suppkey AS short, 'alpha' || s_suppkey || '.io' AS site, 'alpha_' || s_suppkey AS xh, 'al' || s_suppkey || 'pha' AS ih, 'ann person' || s_suppkey AS who FROM supplier
), n AS (SELECT count(*) AS n FROM supplier), posted AS (SELECT event_id AS id, user_id % (n + 3) AS c, CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'instagram' WHEN 'purchase' THEN 'github' WHEN 'signup' THEN 'reddit' ELSE 'web' END AS platform, value AS contribution,
  (event_id * 7) % n AS o, CASE event_id % 7 WHEN 0 THEN 'new release of alpha works ' || (user_id % (n + 3)) || ' today' WHEN 1 THEN 'see alpha' || ((event_id * 7) % n) || '.io news' WHEN 2 THEN 'hello @alpha_' || ((event_id * 7) % n) WHEN 3 THEN 'movie night with friends' WHEN 4 THEN 'quote of the day' WHEN 5 THEN 'thanks ann person' || (user_id % (n + 3)) ELSE 'alpha works ' || ((event_id * 7) % n) || ' and more' END AS t FROM events, n
), plain AS (SELECT *, trim(regexp_replace(regexp_replace(t, '[_-]+', ' ', 'g'), '[^a-z0-9.]+', ' ', 'g')) AS p, event_id_handle FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'alpha_' || c ELSE 'someone' END AS event_id_handle FROM posted)
), seen AS (SELECT plain.*, co.name IS NOT NULL AS resolved, coalesce(regexp_matches(p, '(^|[^a-z0-9])(' || co.name || '|' || co.short || '|' || co.who || ')([^a-z0-9]|$)') OR contains(p, replace(co.site, '_', ' ')) OR (platform = 'x' AND contains(p, co.xh)) OR (platform = 'instagram' AND contains(p, co.ih)), false) AS visible,
    platform = 'x' AND id % 4 = 0 AND co.name IS NOT NULL AS verified, platform = 'instagram' AND contains(event_id_handle, co.ih) AS iown FROM plain LEFT JOIN co USING (c)
), other AS (SELECT id, bool_or(regexp_matches(p, '(^|[^a-z0-9])(' || co.name || '|' || co.short || ')([^a-z0-9]|$)') OR contains(p, co.site) OR regexp_matches(t, '(^|[^a-z0-9])@(' || co.xh || '|' || co.ih || ')([^a-z0-9]|$)')) AS conflict FROM seen, co WHERE co.c <> seen.c GROUP BY 1
), flags AS (SELECT seen.*, coalesce(conflict, false) AS conflict, platform = 'x' AND regexp_matches(p, '\\bquote\\b') AS quote, regexp_matches(p, '\\bmovie\\b') AS off FROM seen LEFT JOIN other USING (id))"""


def posts(spark, sf_dir):
    """Evidence, signals and entities."""
    s, e = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "events")
    k, n = F.col("s_suppkey").cast("string"), s.count()
    entities = s.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Alpha Works "), k).alias("name"), F.concat(F.lit("alpha-works-"), k).alias("slug"), F.concat(F.lit("https://www.alpha"), k, F.lit(".io")).alias("website"))
    link = lambda platform, url, own: s.select(F.col("s_suppkey").alias("entity_id"), F.lit(platform).alias("platform"), url.alias("url"), F.lit(own).alias("own"))
    links = link("x", F.concat(F.lit("https://x.com/alpha_"), k), False).unionByName(link("instagram", F.concat(F.lit("https://instagram.com/al"), k, F.lit("pha/")), False))
    members = s.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Ann Person"), k).alias("name"))
    i, own, o = F.col("event_id"), (F.col("user_id") % (n + 3)).cast("string"), ((F.col("event_id") * 7) % n).cast("string")
    t, m = F.col("event_type"), F.col("event_id") % 7
    platform = F.when(t == "click", "x").when(t == "view", "instagram").when(t == "purchase", "github").when(t == "signup", "reddit").otherwise("web")
    text = F.when(m == 0, F.concat(F.lit("New release of Alpha Works "), own, F.lit(" today"))).when(m == 1, F.concat(F.lit("see https://alpha"), o, F.lit(".io/news"))).when(m == 2, F.concat(F.lit("hello @alpha_"), o))
    text = text.when(m == 3, "movie night with friends").when(m == 4, "Quote of the day").when(m == 5, F.concat(F.lit("thanks Ann Person"), own)).otherwise(F.concat(F.lit("Alpha Works "), o, F.lit(" and more")))
    none = F.lit(None).cast("string")
    handle = F.when(i % 4 == 0, F.concat(F.lit("@Alpha_"), own)).otherwise("someone")
    evidence = e.select(
        i.alias("id"), (F.col("user_id") % (n + 3)).alias("entity_id"), platform.alias("platform"), F.col("value").alias("contribution"), none.alias("review_state"), text.alias("text"), none.alias("raw"), none.alias("author_name"),
        handle.alias("author_handle"), F.lit("https://news.example.org/a").alias("source_url"), none.alias("account_url"), none.alias("match_reason"), none.alias("why"),
    )
    return evidence, a.signals(entities, links, members), entities


@query(f"WITH {POSTED} SELECT id, resolved, visible AS visible_signal, verified AS verified_account, conflict, quote, off AS off_topic FROM flags")
def attribution_signals(spark, sf_dir):
    return a.evidence_flags(*posts(spark, sf_dir)).select("id", "resolved", "visible_signal", "verified_account", "conflict", "quote", "off_topic")


@query(f"""WITH {POSTED}, r AS (SELECT *, CASE WHEN NOT resolved THEN 1 WHEN platform = 'web' THEN 2 WHEN platform = 'github' AND visible THEN 2 WHEN platform = 'github' THEN 1 WHEN platform = 'instagram' THEN 1
  WHEN platform = 'x' AND quote AND NOT visible THEN 1 WHEN conflict AND NOT visible THEN 1 WHEN verified AND off AND NOT visible THEN 4 WHEN verified OR visible THEN 2 WHEN platform = 'reddit' THEN 1 ELSE 4 END AS r FROM flags)
SELECT id, CASE WHEN r = 2 THEN 'verified' ELSE 'needs_review' END AS review_state, CASE r WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS risk, CASE WHEN r = 2 THEN contribution ELSE 0 END AS guarded FROM r""")
def attribution_audit(spark, sf_dir):
    return a.verdicts(*posts(spark, sf_dir)).select("id", "review_state", "risk", "guarded")


@query(f"""WITH {POSTED}, k AS (SELECT platform, CASE WHEN NOT resolved THEN 'high' WHEN platform = 'web' OR (platform <> 'instagram' AND visible) OR (platform = 'x' AND verified AND NOT quote AND NOT conflict AND NOT off) THEN 'low' WHEN platform = 'x' AND NOT quote AND NOT conflict THEN 'medium' ELSE 'high' END AS risk FROM flags)
SELECT platform, risk, count(*) AS n FROM k GROUP BY 1, 2""")
def risk_counts(spark, sf_dir):
    return a.verdicts(*posts(spark, sf_dir)).groupBy("platform", "risk").agg(F.count("*").alias("n"))


#: Each customer as a candidate for one supplier.
@query("""WITH n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT s_suppkey, c_custkey, CASE WHEN (s_suppkey + c_custkey) % 17 = 0 THEN 'rejected' WHEN c_custkey % 19 = 0 THEN 'verified' END AS e, c_custkey % 10 = 1 AS site, c_custkey % 7 = s_suppkey % 7 AS company,
    c_custkey % 3 = s_suppkey % 3 AS dom, c_custkey % 5 = s_suppkey % 5 AS founder, c_acctbal > 5000 AS role, c_custkey % 4 = 0 AS bio, c_custkey % 6 < 3 AS program, c_custkey % 2 = 0 AS batch FROM customer, n JOIN supplier ON s_suppkey = c_custkey % n.n + 1
), s AS (SELECT *, CASE WHEN e IS NOT NULL THEN e WHEN site OR (company AND dom) OR (founder AND role AND (bio OR dom)) OR (founder AND program AND batch) THEN 'verified' ELSE 'needs_review' END AS state FROM r)
SELECT s_suppkey, c_custkey, state, (CASE state WHEN 'verified' THEN 300 WHEN 'needs_review' THEN 200 ELSE 100 END + site::INTEGER * 4 + site::INTEGER + company::INTEGER + dom::INTEGER + founder::INTEGER + role::INTEGER + bio::INTEGER + program::INTEGER + batch::INTEGER)::INTEGER AS rank_value FROM s""")
def identity_rank(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    rows = c.join(s, s["s_suppkey"] == c["c_custkey"] % s.count() + 1)
    k, same = F.col("c_custkey"), lambda n: (F.col("c_custkey") % n) == (F.col("s_suppkey") % n)
    explicit = F.when((F.col("s_suppkey") + k) % 17 == 0, "rejected").when(k % 19 == 0, "verified")
    signals = {
        "official_site": k % 10 == 1, "exact_company": same(7), "domain": same(3), "exact_founder": same(5), "founder_role": F.col("c_acctbal") > 5000, "bio_mentions": k % 4 == 0, "bio_program": k % 6 < 3, "batch_context": k % 2 == 0,
    }
    rows = rows.select("s_suppkey", "c_custkey", explicit.alias("explicit"), *[v.alias(n) for n, v in signals.items()])
    rows = a.identity(rows).withColumn("n_matches", sum((F.col(n).cast("int") for n in signals), F.lit(0)))
    return a.rank_candidates(rows).select("s_suppkey", "c_custkey", "state", "rank_value")


# Reports.

TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


def typed(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("platform"), "value", jround(F.col("value") - 20).alias("score"))


@query("SELECT t AS event_type, count(event_id) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS t) LEFT JOIN events ON event_type = t GROUP BY 1")
def status_counts_zero_filled(spark, sf_dir):
    return p.zero_filled(read(spark, sf_dir, "events"), "event_type", TYPES)


@query("""SELECT t AS platform, count(event_id) AS n_rows, count(*) FILTER (floor(value - 20 + 0.5) > 0) AS n_scored, count(DISTINCT user_id) FILTER (floor(value - 20 + 0.5) > 0) AS n_entities
FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS t) LEFT JOIN events ON event_type = t GROUP BY 1""")
def platform_coverage(spark, sf_dir):
    return p.coverage(typed(spark, sf_dir), TYPES)


@query("""WITH g AS (SELECT DISTINCT user_id, t FROM events, (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS t)
), d AS (SELECT DISTINCT user_id, event_type AS t FROM events WHERE value > 150), o AS (SELECT DISTINCT user_id, event_type AS t FROM events WHERE value > 100)
SELECT user_id AS entity_id, t AS platform, CASE WHEN (user_id, t) IN (SELECT (user_id, t) FROM d) THEN 'completed' WHEN (user_id, t) IN (SELECT (user_id, t) FROM o) THEN 'needs_review' WHEN t = 'refund' THEN 'skipped' WHEN t = 'error' THEN 'blocked_or_empty' ELSE 'queued' END AS status FROM g""")
def coverage_grid(spark, sf_dir):
    rows = typed(spark, sf_dir)
    return p.task_grid(rows.select("entity_id").distinct(), TYPES, rows.filter("value > 150"), rows.filter("value > 100"), ["refund"], ["error"])


@query("""WITH h AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 150)) AS h FROM events GROUP BY 1)
SELECT user_id AS entity_id, array_to_string(coalesce(h, []), ',') AS have, array_to_string(list_filter(['click', 'error', 'purchase', 'refund', 'signup', 'view'], lambda t: NOT list_contains(coalesce(h, []), t)), ',') AS lacking FROM h""")
def missing_platforms(spark, sf_dir):
    rows = typed(spark, sf_dir)
    out = p.missing(rows.select("entity_id").distinct(), TYPES, rows.filter("value > 150"))
    return out.select("entity_id", F.array_join("have", ",").alias("have"), F.array_join("lacking", ",").alias("lacking"))


@query("SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2")
def facet_counts(spark, sf_dir):
    return p.facets(read(spark, sf_dir, "part"), "p_brand").unionByName(p.facets(read(spark, sf_dir, "customer"), "c_mktsegment"))


FEATURES = """f AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (event_type = 'view') AS DOUBLE) * 40 AS views, max(value) FILTER (event_type = 'purchase') * 5 AS stars, count(*) FILTER (event_type IN ('click', 'signup') AND value > 60) AS n_social, count(*) FILTER (value > 60) AS n_scored,
    floor(avg(value) + 0.5) AS score, count(*) FILTER (event_type = 'view') AS n_instagram, count(*) FILTER (event_type = 'click' AND value > 60) AS n_x, count(*) FILTER (event_id % 97 = 0) AS n_foreign, user_id % 5 < 2 AS has_x, CASE WHEN user_id % 3 = 0 THEN 'A Video tool' ELSE 'Payroll' END AS text FROM events GROUP BY 1
), found AS (SELECT user_id, 'high_raw_views_low_score' AS kind, 1 AS n FROM f WHERE views >= 50000 AND score < 40 UNION ALL SELECT user_id, 'high_github_low_score', 1 FROM f WHERE stars >= 1000 AND score < 45 UNION ALL SELECT user_id, 'high_social_low_score', 1 FROM f WHERE n_social >= 3 AND score < 45
  UNION ALL SELECT user_id, 'many_posts_low_score', 1 FROM f WHERE n_scored >= 10 AND score < 35 UNION ALL SELECT user_id, 'no_scored_evidence', 1 FROM f WHERE n_scored = 0
  UNION ALL (SELECT user_id, 'missing_likely_instagram', 1 FROM f WHERE n_instagram = 0 AND regexp_matches(lower(text), 'consumer|creator|video|design|game|social|media|assistant') ORDER BY user_id LIMIT 50)
  UNION ALL SELECT user_id, 'missing_x_posts', 1 FROM f WHERE has_x AND n_x = 0 UNION ALL SELECT user_id, 'cross_company_attribution', n_foreign FROM f WHERE n_foreign > 0)"""


def anomaly_features(spark, sf_dir):
    e, t, v, u = read(spark, sf_dir, "events"), F.col("event_type"), F.col("value"), F.col("user_id")
    scored = v > 60
    return e.groupBy("user_id").agg(
        (F.sum(F.when(t == "view", v.cast("decimal(18,2)"))).cast("double") * 40).alias("views"), (F.max(F.when(t == "purchase", v)) * 5).alias("stars"), F.count_if(t.isin("click", "signup") & scored).alias("n_social"),
        F.count_if(scored).alias("n_scored"), jround(F.avg(v)).alias("score"), F.count_if(t == "view").alias("n_instagram"), F.count_if((t == "click") & scored).alias("n_x"), F.count_if(F.col("event_id") % 97 == 0).alias("n_foreign"),
    ).withColumns({"has_x_account": u % 5 < 2, "text": F.when(u % 3 == 0, "A Video tool").otherwise("Payroll")})


@query(f"WITH {FEATURES} SELECT user_id, kind, n FROM found")
def anomaly_rules(spark, sf_dir):
    return p.anomalies(anomaly_features(spark, sf_dir), "user_id", "user_id").select("user_id", "kind", "n")


@query(f"""WITH {FEATURES}, w AS (SELECT * FROM (VALUES ('high_raw_views_low_score', 'scoring_worker'), ('high_raw_views_low_score', 'metric_worker'), ('high_github_low_score', 'scoring_worker'), ('high_github_low_score', 'discovery_worker'), ('high_social_low_score', 'scoring_worker'), ('many_posts_low_score', 'dedupe_worker'), ('many_posts_low_score', 'scoring_worker'),
  ('no_scored_evidence', 'discovery_worker'), ('no_scored_evidence', 'website_worker'), ('missing_likely_instagram', 'instagram_worker'), ('missing_likely_instagram', 'discovery_worker'), ('missing_x_posts', 'profile_worker'), ('missing_x_posts', 'platform_post_worker'), ('cross_company_attribution', 'dedupe_worker'), ('cross_company_attribution', 'profile_worker')) AS v(kind, worker))
SELECT user_id, kind, worker, n, CASE WHEN contains(kind, 'instagram') THEN 'high' ELSE 'normal' END AS priority, c_mktsegment || ' Spring' AS query_seed FROM found JOIN w USING (kind) JOIN customer ON c_custkey = user_id""")
def anomaly_follow_ups(spark, sf_dir):
    found = p.anomalies(anomaly_features(spark, sf_dir), "user_id", "user_id")
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return p.follow_ups(found, names, "user_id", "c_mktsegment", "Spring")


@query("""SELECT role AS platform, CASE WHEN length(text) > 200 THEN 'ok' ELSE 'empty' END AS status, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]+"', '{name}', 'g'), 'https?://[^ ]+', '{url}', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 1, 180) AS pattern,
  count(*) AS n, CAST(sum(turn) AS BIGINT) AS results FROM conversations GROUP BY 1, 2, 3 ORDER BY n DESC, platform, status, pattern LIMIT 30""")
def attempt_patterns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return p.attempt_patterns(c.select(F.col("role").alias("platform"), F.when(F.length("text") > 200, "ok").otherwise("empty").alias("status"), F.col("text").alias("query"), F.col("turn").alias("results")))


@query("""WITH RECURSIVE n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events), digits AS (SELECT '0123456789abcdefghijklmnopqrstuvwxyz' AS d)
SELECT event_id, 'ev-' || CASE WHEN k >= 46656 THEN d[((k // 46656) % 36 + 1)::BIGINT] ELSE '' END || CASE WHEN k >= 1296 THEN d[((k // 1296) % 36 + 1)::BIGINT] ELSE '' END || CASE WHEN k >= 36 THEN d[((k // 36) % 36 + 1)::BIGINT] ELSE '' END || d[(k % 36 + 1)::BIGINT] AS compact_id FROM n, digits""")
def sanitized_ids(spark, sf_dir):
    return g.compact_ids(read(spark, sf_dir, "events"), "ev-", "ts", "event_id").select("event_id", "compact_id")
