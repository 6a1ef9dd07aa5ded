"""Attribution of evidence to entities, and identity of accounts. Flags are columns; rules are one ordered `when`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.num import jround
from tidemark.functions.text import compact, has_phrase, plain
from tidemark.functions.urls import host, own_handle, site_handle
from tidemark.session import durable

#: What may well be about something else unless the text says so.
AMBIGUOUS = ("product_hunt", "youtube", "hacker_news", "reddit", "linkedin")
#: Classes of business by words, the first that matches.
CLASSES = (
    ("open_source", ("github", "open source")), ("marketplace", ("marketplace",)), ("api", ("api",)), ("developer_tools", ("developer", "infrastructure", "devtool")),
    ("hardware", ("hardware", "robot", "device", "sensor")), ("fintech", ("fintech", "payment", "bank")), ("healthcare", ("healthcare", "medical", "diagnostic")),
    ("industrial", ("industrial", "manufacturing", "defense")), ("consumer", ("consumer",)), ("services", ("agency", "service")),
)


def classify(text: Column, classes=CLASSES, otherwise: str = "b2b") -> Column:
    out, low = F.lit(otherwise), F.lower(text)
    for name, words in reversed(classes):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


#: Most distinct keys, 64-bit numbers, that are broadcast to sift what texts hold (some 60 bytes each); beyond, they are joined by shuffling.
BROADCAST_KEYS = 2_000_000
#: Texts with one key that one task holds; those of a hotter key are dealt over several.
SPREAD = 200_000


def rarest_pairs(asked: DataFrame, given: DataFrame) -> DataFrame:
    """The columns of `asked` and `given` but the keys, for each item of `given` and each row of `asked` that holds the item's rarest key.

    asked: key and others. given: keys (all of which what holds the item has)
    and others, each once. Keys are those of `_key`, and what comes of them is to
    be verified. Only keys of `given` leave the rows they stand in; the fewer rows
    hold a key, the fewer pairs it makes. An item with a key that nothing holds is
    in no pair. Rows of a key that more than SPREAD of them hold are dealt out, and
    its items copied to each deal.
    """
    wanted = given.select(F.explode("keys").alias("key")).distinct()
    few = wanted.count() <= BROADCAST_KEYS
    hits = durable(asked.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "key", "left_semi"), "hits")
    held = hits.groupBy("key").agg(F.count("*").alias("_n"))
    others = [c for c in given.columns if c != "keys"]
    keyed = given.select(*others, F.explode("keys").alias("key")).join(held, "key", "left")
    chosen = keyed.groupBy(*others).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "key")).alias("_k")).filter("_k.n > 0")
    deals = F.ceil(F.col("_k.n") / SPREAD).cast("int")
    chosen = chosen.select(*others, F.col("_k.key").alias("key"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("_deal"))
    hot = held.filter(F.col("_n") > SPREAD).select("key", F.ceil(F.col("_n") / SPREAD).cast("int").alias("_deals"))  # a row for SPREAD hits at most
    dealt = hits.join(F.broadcast(hot), "key", "left").withColumn("_deal", F.when(F.col("_deals").isNull(), 0).otherwise(F.floor(F.rand(1) * F.col("_deals")).cast("int")))
    return dealt.join(chosen, ["key", "_deal"]).drop("key", "_deal", "_deals")


def _key(by: str, *parts: Column) -> Column:
    """A key as a number: 64 bits of what it is and of its parts, quicker to explode and to join than words."""
    return F.xxhash64(F.lit(by), *parts)


def _words(text: Column) -> Column:
    """The words of a text in plain form; points part them too."""
    return F.array_remove(F.split(text, "[ .]+"), "")


def _neighbours(words: Column) -> Column:
    """The keys of each two neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: _key("word", a, b))


def _phrase_keys(words: Column) -> Column:
    """What a text that has the phrase of these words has: its neighbouring words, or its only one."""
    return F.array_distinct(F.when(F.size(words) == 1, F.transform(words, lambda w: _key("word", w))).otherwise(_neighbours(words)))


def _text_keys(words: Column) -> Column:
    """All words and neighbouring words of a text, each once; `words` is best a column, which is taken apart once."""
    return F.array_distinct(F.concat(F.transform(words, lambda w: _key("word", w)), _neighbours(words)))


def phrase_hits(texts: DataFrame, phrases: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, phrase_id of phrases (phrase_id, phrase) that stand in a text as whole tokens.

    Ids of texts meet phrases by the phrase's rarest two neighbouring words;
    the texts of these pairs follow and verify them. Phrases without a letter
    or digit stand in no text.
    """
    asked = texts.select(id_column, _words(plain(F.col(text))).alias("_w")).select(id_column, F.explode(_text_keys(F.col("_w"))).alias("key"))
    p = phrases.select("phrase_id", plain(F.col("phrase")).alias("_p"))
    given = p.select("phrase_id", "_p", _phrase_keys(_words(F.col("_p"))).alias("keys")).distinct()
    pairs = durable(rarest_pairs(asked, given), "pairs")
    met = texts.select(id_column, text).join(pairs.select(id_column).distinct(), id_column, "left_semi").select(id_column, plain(F.col(text)).alias("_t"))
    return met.join(pairs, id_column).filter(has_phrase(F.col("_t"), F.col("_p"))).select(id_column, "phrase_id").distinct()


#: Single words that are names of entities and say nothing by themselves.
GENERIC_NAMES = """aice arden bloom chert cohesion dispatch drafted flow flowscope frame hedge hub hyper
jo modern pentagon pluto primitive replicas result runtime stage standout superset thomas walter""".split()
#: Hosts of which an address does not make a site one's own; words of private life.
SOCIAL_HOSTS = ("x.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "youtu.be")
OFF_TOPIC = r"\b(3 idiots|algorithm wants|barista|coffee shop|gym|hoop|marina theater|milk|movie|movies|restaurant|subtitles|theater|theatre|vacation|wedding)\b"


def distinctive_names(name: Column, slug: Column) -> Column:
    """The forms of a name and its slug that can stand for it: of several words, or one of five letters that is not generic."""
    forms = F.array_distinct(F.array(plain(name), plain(F.replace(slug, F.lit("-"), F.lit(" "))), compact(name), compact(slug)))
    return F.filter(forms, lambda x: (x != "") & (F.contains(x, F.lit(" ")) | ((F.length(x) >= 5) & ~x.isin(GENERIC_NAMES))))


def signals(entities: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """entity_id, kind (name, member, domain, handle), platform (of handles) and value, each once.

    entities: entity_id, name, slug, website. links: entity_id, platform, url,
    own (of the entity, not of a member). members: entity_id, name.
    """
    none = F.lit(None).cast("string")
    of = lambda df, kind, value, platform=none: df.select("entity_id", F.lit(kind).alias("kind"), platform.alias("platform"), value.alias("value"))
    names = of(entities, "name", F.explode(distinctive_names(F.col("name"), F.col("slug"))))
    sites = entities.select("entity_id", F.col("website").alias("url")).unionByName(links.filter("own").select("entity_id", "url"))
    rows = names.unionByName(of(members, "member", plain(F.col("name")))).unionByName(of(sites, "domain", host(F.col("url"))))
    return rows.unionByName(of(links, "handle", site_handle(F.col("url")), F.col("platform"))).filter("value <> ''").distinct()


def visible_text(text: Column, raw: Column) -> Column:
    """What a post shows: its text and, of a captured JSON record, the fields with words; else the capture as it is."""
    parsed = F.try_parse_json(raw)
    fields = [F.try_variant_get(parsed, f"$.{k}", "string") for k in ("text", "caption", "title", "story_text", "description", "full_text")]
    body = F.when(parsed.isNull(), raw).otherwise(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in fields]))
    return F.concat_ws(" ", F.nullif(text, F.lit("")), F.nullif(body, F.lit("")))


def _tagged(low: Column) -> Column:
    """What a text in lower case may name as a handle: after @, up to each sign that may end one, and in addresses."""
    tagged = F.regexp_extract_all(low, F.lit(r"(?:^|[^a-z0-9])@([a-z0-9._-]{4,})"), F.lit(1))
    linked = F.regexp_extract_all(low, F.lit(r"(?:x|twitter|instagram|linkedin|github)\.com/([^/\"'\s?#]{4,})"), F.lit(1))
    ends = F.flatten(F.transform(tagged, lambda x: F.filter(F.transform(F.sequence(F.lit(4), F.length(x)), lambda i: F.when((i == F.length(x)) | F.rlike(F.substr(x, i + 1, F.lit(1)), F.lit("[^a-z0-9]")), F.substr(x, F.lit(1), i))), lambda y: y.isNotNull())))
    none = F.array().cast("array<string>")
    return F.concat(F.when(F.contains(low, F.lit("@")), ends).otherwise(none), F.when(F.contains(low, F.lit(".com/")), linked).otherwise(none))


def conflict_pairs(evidence: DataFrame, signal: DataFrame) -> DataFrame:
    """id, other, kind and value of signals that the visible text of evidence may show, for entities besides its own.

    evidence: id, entity_id, visible. Names meet a text by their rarest two
    neighbouring words, domains by the rarest of their labels that a point
    follows (the first may be the end of a longer one in the text, others stand
    alone), handles by themselves; so no text meets every entity.
    """
    signal = signal.filter("kind = 'name' OR kind = 'domain' AND value LIKE '%.%' OR kind = 'handle' AND length(value) >= 4")
    labels = F.filter(F.split(F.regexp_replace("value", r"\.[^.]*$", ""), r"\."), lambda x: x != "")
    longest = signal.filter("kind = 'domain'").agg(F.max(F.array_max(F.transform(labels, lambda k: F.length(k))))).first()[0] or 0
    in_domain = lambda x: F.transform(x, lambda k: _key("domain", k))
    keys = F.when(F.col("kind") == "name", _phrase_keys(_words(F.col("value")))).when(F.col("kind") == "domain", in_domain(labels)).otherwise(F.array(_key("handle", F.col("value"))))
    given = signal.select(F.col("entity_id").alias("other"), "kind", "value", F.array_distinct(keys).alias("keys")).distinct()
    t, low = F.col("_t"), F.col("_low")
    before = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"([^ .]+)(?=\.)"), F.lit(1)), lambda x: F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(longest))), lambda n: F.right(x, n))))
    none = F.array().cast("array<bigint>")
    others = F.concat(F.when(F.contains(t, F.lit(".")), in_domain(before)).otherwise(none), F.transform(_tagged(low), lambda h: _key("handle", h)))
    shown = evidence.select("id", F.col("entity_id").alias("own"), plain(F.col("visible")).alias("_t"), F.lower(F.coalesce("visible", F.lit(""))).alias("_low")).withColumn("_w", _words(t))
    asked = shown.select("id", "own", F.explode(F.concat(_text_keys(F.col("_w")), F.array_distinct(others))).alias("key"))
    return rarest_pairs(asked, given).filter("own <> other").select("id", "other", "kind", "value")


def conflicts(evidence: DataFrame, signal: DataFrame) -> DataFrame:
    """id and other, the entities besides its own whose name, domain or handle the visible text of evidence shows."""
    pairs = durable(conflict_pairs(evidence, signal), "pairs")
    met = evidence.select("id", "visible").join(pairs, "id").withColumn("_t", plain(F.col("visible")))
    tagged = F.array_contains(_tagged(F.lower("visible")), F.col("value"))
    holds = F.when(F.col("kind") == "name", has_phrase(F.col("_t"), F.col("value"))).when(F.col("kind") == "domain", F.contains("_t", "value")).otherwise(tagged)
    return met.filter(holds).select("id", "other").distinct()


def evidence_flags(evidence: DataFrame, signal: DataFrame, entities: DataFrame) -> DataFrame:
    """`evidence` with the flags that `guard` reads.

    evidence: id (unique), entity_id (the entity it is attached to), platform,
    contribution, review_state, text, raw, author_name, author_handle,
    source_url, account_url, match_reason, why.
    """
    signal = durable(signal, "signals")
    rows = _own_flags(evidence, signal, entities)
    shown = evidence.select("id", "entity_id", visible_text(F.col("text"), F.col("raw")).alias("visible"))
    found = conflicts(shown, signal).select("id").distinct().withColumn("conflict", F.lit(True))
    rows = rows.join(found, "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return rows.select(*evidence.columns, "resolved", "conflict", *[c for c in rows.columns if c not in ("resolved", "conflict", *evidence.columns)])


def verdicts(evidence: DataFrame, signal: DataFrame, entities: DataFrame) -> DataFrame:
    """id, platform, contribution and what `guard` makes of `evidence_flags`: review_state, multiplier, risk, guarded.

    Takes what `evidence_flags` takes. Each row is judged both with and without
    a conflict; where both verdicts are one, nothing turns on a conflict, so
    only the other rows meet the signals of all entities.
    """
    signal = durable(signal, "signals")
    judged = _own_flags(evidence, signal, entities).withColumns({"_clear": _verdict(F.lit(False)), "_torn": _verdict(F.lit(True))}).withColumn("_open", ~F.col("_clear").eqNullSafe(F.col("_torn")))
    visible = F.when(F.col("_open"), visible_text(F.col("text"), F.col("raw"))).alias("visible")
    judged = durable(judged.select("id", "entity_id", "platform", "contribution", "_clear", "_torn", "_open", visible), "judged")
    unsure = judged.filter("_open")
    found = conflicts(unsure.select("id", "entity_id", "visible"), signal).select("id").distinct().withColumn("_conflict", F.lit(True))
    settled = judged.filter("NOT _open").select("id", "platform", "contribution", F.col("_clear").alias("_g"))
    decided = unsure.join(found, "id", "left").select("id", "platform", "contribution", F.when(F.col("_conflict"), F.col("_torn")).otherwise(F.col("_clear")).alias("_g"))
    return _judged(settled.unionByName(decided))


def _own_flags(evidence: DataFrame, signal: DataFrame, entities: DataFrame) -> DataFrame:
    """`evidence` with all flags but conflict: what a row shows of its own entity."""
    own = signal.groupBy("entity_id").agg(
        F.collect_set(F.when(F.col("kind").isin("name", "member"), F.col("value"))).alias("_names"), F.collect_set(F.when(F.col("kind") == "domain", F.col("value"))).alias("_domains"),
        F.collect_set(F.when(F.col("kind") == "handle", F.struct("platform", "value"))).alias("_handles"),
    )
    about = entities.select("entity_id").distinct().withColumn("resolved", F.lit(True)).join(own, "entity_id", "full")
    visible = visible_text(F.col("text"), F.col("raw"))
    who = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("author_name", "author_handle", "source_url", "account_url", "match_reason", "why")])
    empty = F.array().cast("array<string>")
    handles = F.transform(F.filter("_handles", lambda h: h["platform"] == F.col("platform")), lambda h: h["value"])
    # What lambdas read is a column first, or they would work it out anew for each element.
    rows = evidence.join(about, "entity_id", "left").withColumns({
        "_names": F.coalesce("_names", empty), "_domains": F.coalesce("_domains", empty), "_mine": F.coalesce(handles, empty), "_visible": plain(visible), "_who": plain(who), "_site": host(F.col("source_url")),
    })
    shows = lambda text: F.exists("_names", lambda n: has_phrase(text, n)) | F.exists("_domains", lambda d: F.contains(text, d)) | F.exists("_mine", lambda h: F.contains(text, h))
    site = F.col("_site")
    social = F.coalesce(F.exists(F.array(*map(F.lit, SOCIAL_HOSTS)), lambda s: (site == s) | F.endswith(site, F.concat(F.lit("."), s))), F.lit(True))
    at_home = ~social & F.exists("_domains", lambda d: (site == d) | F.endswith(site, F.concat(F.lit("."), d)))
    capture = F.when(F.col("platform") == "instagram", captured_handle(F.col("raw")))
    accounts = F.array(own_handle(F.coalesce("author_handle", "author_name")), site_handle(F.coalesce("account_url", "source_url")), site_handle(F.col("source_url")), capture)
    yes = lambda c: F.coalesce(c, F.lit(False))
    x = F.col("platform") == "x"
    context = (F.col("contribution") <= 0) & F.coalesce("why", "match_reason").rlike("(?i)profile|identity context|context only")
    flags = {
        "resolved": yes(F.col("resolved")), "visible_signal": yes(shows(F.col("_visible"))) | yes(at_home), "own_signal": yes(shows(F.col("_who"))),
        "verified_account": yes((F.size("_mine") > 0) & F.arrays_overlap(F.filter(accounts, lambda a: F.coalesce(a, F.lit("")) != ""), "_mine")),
        "context_only": yes(x & F.col("raw").rlike(r'(?i)"is_retweet"\s*:\s*true')) | yes(context), "quote": yes(x & F.col("_visible").rlike(r"\bquote\b")), "off_topic": yes(F.col("_visible").rlike(OFF_TOPIC)),
    }
    return rows.withColumns(flags).select(*evidence.columns, *flags)  # before any join by id, so that it carries flags and no lists


def captured_handle(raw: Column) -> Column:
    """The account in a captured record of a picture post."""
    some = lambda p: F.nullif(own_handle(F.regexp_extract(raw, p, 1)), F.lit(""))
    field = lambda p: F.nullif(F.get_json_object(raw, p), F.lit(""))
    post = r"(?i)instagram\.com/([^/]+)/(?:p|reel|tv)/"
    href = F.coalesce(field("$.gridUrl.rawHref"), field("$.gridUrl.href"))
    parsed = F.coalesce(F.nullif(site_handle(field("$.profile.url")), F.lit("")), F.nullif(own_handle(field("$.profile.username")), F.lit("")), F.nullif(own_handle(F.regexp_extract(href, post, 1)), F.lit("")))
    return F.when(F.try_parse_json(raw).isNotNull(), parsed).otherwise(F.coalesce(some(post), some(r'(?i)"url"\s*:\s*"https?://(?:www\.)?instagram\.com/([^"/]+)')))


def guard(rows: DataFrame) -> DataFrame:
    """`rows` with the guarded review_state, multiplier, risk and contribution.

    rows: platform, contribution, review_state (null counts as verified), and
    the flags resolved, verified_account, visible_signal (of the own entity, in
    what the post shows), own_signal (there, or in who wrote it and where),
    context_only, quote, conflict and off_topic. The first rule that holds decides.
    """
    return _judged(rows.withColumn("_g", _verdict(F.col("conflict"))))


def _verdict(conflict: Column) -> Column:
    """state, multiplier and risk by the rules of `guard`."""
    f = F.col
    visible, own, verified = f("visible_signal"), f("own_signal") | f("visible_signal"), f("verified_account")
    review_high, keep, drop = ("needs_review", 0.0, "high"), (None, 1.0, "low"), (None, 0.0, "low")
    rules = [
        (~f("resolved"), review_high),
        (f("platform").isin("web", "rss"), keep),
        ((f("platform") == "github") & (verified | own), keep),
        (f("platform") == "github", review_high),
        (f("context_only"), drop),
        ((f("platform") == "instagram") & ~verified, review_high),
        ((f("platform") == "x") & f("quote") & ~visible, review_high),
        (conflict & ~visible, review_high),
        (verified & f("off_topic") & ~visible, ("needs_review", 0.0, "medium")),
        (verified | own, keep),
        (f("platform").isin(*AMBIGUOUS), review_high),
    ]
    held = F.coalesce(f("review_state"), F.lit("verified"))
    result = lambda state, multiplier, risk: F.struct((F.lit(state) if state else held).alias("state"), F.lit(multiplier).alias("multiplier"), F.lit(risk).alias("risk"))
    out = result("needs_review", 0.0, "medium")
    for when, decided in reversed(rules):
        out = F.when(when, result(*decided)).otherwise(out)
    return out


def _judged(rows: DataFrame) -> DataFrame:
    """`rows` with their verdict, the column _g, taken apart."""
    guarded = F.when(F.col("_g.multiplier") > 0, F.col("contribution")).otherwise(jround(F.col("contribution") * F.col("_g.multiplier")))
    return rows.select(*[c for c in rows.columns if c not in ("_g", "review_state")], F.col("_g.state").alias("review_state"), "_g.multiplier", "_g.risk", guarded.alias("guarded"))


#: Platforms whose rows need a sign of their own entity.
STRICT = ("youtube", "product_hunt", "hacker_news", "reddit", "linkedin")


def offline_audit(rows: DataFrame) -> DataFrame:
    """`rows` with risk and reason by the simpler rules of an audit after the fact; the first that holds decides.

    rows: platform, contribution, why, match_reason, raw, and the flags
    resolved, own_signal (anywhere in the row), verified_account and conflict.
    What the guard has called low risk stays so.
    """
    f = F.col
    said = F.concat_ws(" ", "why", "match_reason").rlike(r"(?i)Attribution guard:\s*low risk")
    own, verified = f("own_signal"), f("verified_account")
    context = (F.coalesce("contribution", F.lit(0.0)) <= 0) | F.concat_ws(" ", "why", "raw").rlike("(?i)profile|context only|retweet|repost")
    bare = ~own & ~verified & ~context
    rules = [
        (said, "low", "guarded"), (~f("resolved"), "high", "unresolved"), ((f("platform") == "github") & ~own & ~verified, "high", "unknown_repository"), (f("conflict") & ~own, "high", "other_entity"),
        (bare & f("platform").isin(*STRICT), "high", "no_signal"), (bare, "medium", "weak_signal"), (verified, "low", "verified_account"),
    ]
    out = F.struct(F.lit("low").alias("risk"), F.lit("visible_signal").alias("reason"))
    for when, risk, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(risk).alias("risk"), F.lit(reason).alias("reason"))).otherwise(out)
    return rows.withColumn("_o", out).select(*rows.columns, "_o.risk", "_o.reason")


def identity(rows: DataFrame) -> DataFrame:
    """`rows` with state and canonical: explicit states win, then the rules that verify; all else needs review.

    Flags: explicit (a state or null), official_site, exact_company, domain,
    exact_founder, founder_role, bio_mentions, bio_program, batch_context.
    """
    f = F.col
    verified = (
        f("official_site") | (f("exact_company") & f("domain")) | (f("exact_founder") & f("founder_role") & (f("bio_mentions") | f("domain"))) | (f("exact_founder") & f("bio_program") & f("batch_context"))
    )
    state = F.when(f("explicit").isin("rejected", "verified"), f("explicit")).when(verified, "verified").otherwise("needs_review")
    return rows.withColumn("state", state).withColumn("canonical", F.col("state") == "verified")


def rank_candidates(rows: DataFrame) -> DataFrame:
    """`rows` (state, official_site, n_matches) with rank_value: 100 by the state's rank (verified 3, needs_review 2, rejected 1), 4 for the official site, 1 a match."""
    state = F.when(F.col("state") == "verified", 3).when(F.col("state") == "needs_review", 2).otherwise(1)
    return rows.withColumn("rank_value", state * 100 + F.col("official_site").cast("int") * 4 + F.col("n_matches"))


def identity_signals(rows: DataFrame, as_of: Column) -> DataFrame:
    """`rows` with the flags that `identity` reads, and n_matches, how many of the ten hold.

    rows: entity_type (company or founder), name, company_name, batch, website
    of the entity; explicit, display_name, handle, bio, site, verified,
    on_official_site, active_at of the candidate. Null texts match nothing. A
    batch stands in a bio where a word begins, or after YC: 'works2026' has no S2026.
    """
    f, key = F.col, compact
    has = lambda text, part: (key(part) != "") & F.contains(key(text), key(part))
    apart = F.concat(F.lit("(^|[^a-z0-9])(yc)?"), F.regexp_replace(key(f("batch")), "(.)", "$1[^a-z0-9]*"))
    batch = (key(f("batch")) != "") & F.rlike(F.lower("bio"), apart)
    named = ((key(f("display_name")) == key(f("name"))) | (key(f("handle")) == key(f("name")))) & (key(f("name")) != "")
    company = F.coalesce("company_name", F.when(f("entity_type") == "company", f("name")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(f("active_at").cast("timestamp"))) / 86_400_000_000.0
    flags = {
        "official_site": yes(f("on_official_site")), "exact_company": (f("entity_type") == "company") & named, "exact_founder": (f("entity_type") == "founder") & named, "domain": yes(host(f("website")) == host(f("site"))),
        "bio_mentions": has(f("bio"), company), "bio_program": yes(f("bio").rlike(r"(?i)\bYC\b|Y\s*Combinator")), "founder_role": (f("entity_type") == "founder") & yes(f("bio").rlike(r"(?i)\bfounder\b|\bco-founder\b")),
        "batch_context": yes(batch), "verified_account": yes(f("verified")), "recent_activity": yes(age.between(0, 90)),
    }
    return rows.withColumns(flags).withColumn("n_matches", sum((F.col(k).cast("int") for k in flags), F.lit(0)))


def profile_matches(rows: DataFrame) -> DataFrame:
    """`rows` with `matches`: whether a picture profile is an entity's.

    rows: entity_type, name, company_name, website, reason of the target;
    display_name, external, bio, followers of the profile. A link that names
    the company or its site decides; else the display name must be exact, and
    where it came from, how many words it has, and followers or bio must bear it out.
    """
    f = F.col
    domain = F.split_part(host(f("website")), F.lit("."), F.lit(1))
    tokens = F.filter(F.array(compact(f("company_name")), compact(domain)), lambda t: F.length(t) >= 4)
    external, bio, shown = compact(f("external")), compact(f("bio")), compact(f("display_name"))
    own = F.when(f("entity_type") == "company", f("company_name")).otherwise(f("name"))
    exact = (shown != "") & ((shown == compact(own)) | (shown == compact(f("company_name"))))
    told = lambda pattern: F.coalesce(f("reason").rlike(pattern), F.lit(False))
    searched = told("(?i)Web Instagram search|OpenCLI Instagram search") & ~told("(?i)live instagram identity validation|manual verified|visible read-only social profiles")
    several = F.size(F.split(F.trim(own), r"\s+")) >= 2
    company = told("(?i)official company website|official website outbound|source chain starts") | (several & (F.coalesce("followers", F.lit(100)) >= 100))
    founder = several | F.exists(tokens, lambda t: F.contains(bio, t))
    linked = (external != "") & F.exists(tokens, lambda t: F.contains(external, t))
    return rows.withColumn("matches", linked | (exact & ~searched & F.when(f("entity_type") == "company", company).otherwise(founder)))
