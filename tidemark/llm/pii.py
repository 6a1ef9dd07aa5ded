"""Personal data: patterns, and terms that reveal the protected values they stand by.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these
values are the protected entities. Co-occurrence over the corpus then tells
what other words reveal: for an entity c and a term t in the same text, the
pointwise mutual information log2(N * n_ct / (n_c * n_t)), where n_ct and n_c
count distinct texts with both and with the entity, n_t distinct texts with
the term, and N all distinct texts. Terms that give away a share of the
entity's information log2(N / n_c) are generalised, and removed above a higher
share, wherever they stand in a text that holds the entity. Only texts that
differ count, so copies of one text are no evidence. All counts are exact:
merged sketches of n_t only rule out terms that are far too frequent before
the others are counted.

A generalised term gives way to the class of what is written like it (number,
code, name or word), which covers so many texts that it reveals next to nothing.

All of it is DataFrame expressions. Matching is done once, where the texts
lie; what is shuffled afterwards are texts with an entity that SUPPORT texts hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.tables import table
from tidemark.session import durable

#: The kinds in their order, and their patterns. Quantifiers are
#: possessive where nothing can be given back, so long runs take linear time
#: and no stack; an address starts where a run of its characters starts.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = IN_WORD + "+"
#: Distinct texts that an entity and a term must share.
SUPPORT = 3
#: Shares of an entity's information above which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: How far the sketched count of texts may exceed the most that a revealing term can have before the term is ruled out, and the sketches' standard error: ten of these errors.
MARGIN, SKETCH_ERROR = 2.0, 0.1
#: Most candidate terms that are broadcast; beyond, the counts are joined by shuffling.
BROADCAST_TERMS = 500_000
#: Elements that are scanned, and characters that are cut out, block by block.
BLOCK, CHUNK = 256, 4096
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _scan(xs: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """All that `step` (state and element to the next state and an array of `kind`) gives along `xs`, from the state `first` on.

    Appending copies an array, so elements go in blocks: a step copies what its
    block has, and a block the list of blocks, not all before it.
    """

    def within(state: Column, block: Column) -> Column:
        start = F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def one(s: Column, x: Column) -> Column:
            at, out = step(s["at"], x)
            return F.struct(at.alias("at"), F.concat(s["out"], out).alias("out"))

        return F.aggregate(block, start, one)

    def along(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        done = F.aggregate(blocks, start, lambda s, b: _let(within(s["at"], b), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))))
        return F.flatten(done["out"])

    return _let(xs, lambda xs: F.when(F.size(xs) > 0, along(xs)).otherwise(F.array().cast(f"array<{kind}>")))


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value) of the leftmost matches that do not overlap, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.arrays_zip(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("value"), gaps.alias("gap"))
    kind = "struct<start:int,end:int,value:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return end, F.when(x["value"].isNotNull(), found).otherwise(F.array().cast(f"array<{kind}>"))

    return _scan(both, F.lit(0), step, kind)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans_of(kind: str, found: Column) -> Column:
    held = F.filter(found, lambda x: _holds(kind, x["value"]))
    return F.transform(held, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by kind and start."""
    may = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    kinds = []
    for kind, pattern in KINDS.items():
        spans = _spans_of(kind, located(text, pattern))
        kinds.append(F.when(may[kind] & text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*kinds)


def entity(kind: Column, value: Column) -> Column:
    """What a value stands for, however it is written."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _with_spans(docs: DataFrame) -> DataFrame:
    """`row` (unique), the own columns but the text as `kept`, spans, and the text where it has any."""
    others = [c for c in docs.columns if c != "text"]
    found = docs.select(F.struct(*others).alias("kept"), F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))).withColumn("row", F.monotonically_increasing_id())


def _held(found: DataFrame) -> DataFrame:
    """row, entity and `seen` (a hash of the text) of the entities that each row holds."""
    entities = F.array_distinct(F.transform("spans", lambda x: entity(x["kind"], x["value"])))
    return found.filter(F.size("spans") > 0).select("row", F.xxhash64("text").alias("seen"), F.explode(entities).alias("entity"))


def _terms(found: DataFrame, of_entity: DataFrame) -> DataFrame:
    """row, seen, its entities that are in `of_entity`, and the words outside its spans."""
    rows = _held(found).join(of_entity.select("entity"), "entity").groupBy("row", "seen").agg(F.collect_list("entity").alias("entities"))
    outside = _replaced(F.col("text"), F.col("spans"), lambda _: F.lit(" "))
    return found.select("row", "text", "spans").join(rows, "row").select("row", "seen", "entities", words(outside).alias("terms"))


def _pairs(terms: DataFrame) -> DataFrame:
    return terms.select("row", "entities", F.explode("terms").alias("term")).select("row", "term", F.explode("entities").alias("entity"))


def revealing(terms: DataFrame, of_entity: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, share): the share of the entity's information that the term gives away, where it is GENERALISE at least.

    Counts cover all rows of `docs`; a term counts where it shares SUPPORT
    distinct texts with the entity at least.
    """
    first = terms.groupBy("seen").agg(F.min("row").alias("row")).select("row")
    pairs = _pairs(terms.join(first, "row", "left_semi")).groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    pairs = durable(pairs.filter(F.col("n_ct") >= SUPPORT).join(of_entity, "entity"), "pairs")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = texts.select(F.xxhash64("text").alias("seen")).distinct().count()
    n = F.lit(float(max(total, 1)))
    # A share of GENERALISE needs n_t <= n_ct * (N / n_c) ** (1 - GENERALISE).
    bound = pairs.groupBy("term").agg(F.max(F.col("n_ct") * F.pow(n / F.col("n_c"), F.lit(1 - GENERALISE))).alias("most"))
    candidates = durable(bound, "candidates")
    of_term = _with_words(texts, candidates).groupBy("term").agg(F.approx_count_distinct("seen", SKETCH_ERROR).alias("about"))
    rare = durable(candidates.join(of_term, "term").filter(F.col("about") <= MARGIN * F.col("most")).select("term"), "rare")
    of_term = _with_words(texts, rare).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    known = F.greatest(F.log2(n / F.col("n_c")), F.lit(1e-9))
    shared = F.log2(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    scored = pairs.join(of_term, "term").select("entity", "term", (shared / known).alias("share"))
    return durable(scored.filter(F.col("share") >= GENERALISE), "revealing")


def _with_words(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """seen (a hash of the text) and term of all texts that have a wanted term."""
    every = texts.select(F.xxhash64("text").alias("seen"), F.explode(words(F.col("text"))).alias("term"))
    few = wanted.count() <= BROADCAST_TERMS
    return every.join(F.broadcast(wanted.select("term")) if few else wanted.select("term"), "term", "left_semi")


def _occurrences(text: Column, shares: Column) -> Column:
    """Spans of all words of the text that are a key of `shares` (a map from term to share)."""
    forms = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.map_contains_key(shares, F.lower(w)))
    pattern = F.concat(F.lit(f"(?<!{IN_WORD})(?:"), F.array_join(forms, "|"), F.lit(f")(?!{IN_WORD})"))

    def span(w: Column) -> Column:
        term = F.lower(w["value"])
        return F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), term.alias("value"), F.when(shares[term] >= REMOVE, "remove").otherwise("generalise").alias("action"))

    return F.when(F.size(forms) > 0, F.transform(located(text, pattern), span))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but the text, with spans: array of (kind, start, end, value, action), by kind, then start.

    kind is email, ip, card, phone or term; ends are exclusive; positions are
    code points of the whole text. action is replace for the patterns,
    generalise or remove for terms. Null counts as empty. Repeated rows each
    come back. A column of `docs` named spans gives way to the new one; other
    columns named like one of this operator's own stay.
    """
    docs = docs.drop("spans")
    found = durable(_with_spans(docs), "found")
    of_entity = _held(found).select("entity", "seen").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    of_entity = durable(of_entity.filter(F.col("n_c") >= SUPPORT), "entities")
    terms = durable(_terms(found, of_entity), "near")
    given = revealing(terms, of_entity, docs)
    more = _pairs(terms).join(F.broadcast(given) if given.count() <= BROADCAST_TERMS else given, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    more = more.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    base = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit("replace").alias("action")))
    out = found.join(more, "row", "left").withColumn("terms", F.when(F.col("shares").isNotNull(), _occurrences(F.col("text"), F.col("shares"))))
    extra = _clear(F.col("terms"), F.col("spans"))
    return out.select("kept.*", F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, extra)).alias("spans"))


def _clear(terms: Column, spans: Column) -> Column:
    """`terms` that overlap no span: in order of place, no span that begins before a term ends reaches into it."""
    kind = "struct<kind:string,start:int,end:int,value:string,action:string>"
    none = F.lit(None).cast(kind)
    rows = [
        F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("after"), s["end"].alias("end"), none.alias("term"))),
        F.transform(terms, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("after"), t["start"].alias("end"), t.alias("term"))),
    ]

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        is_term = x["after"] == 0
        return F.when(is_term, reach).otherwise(F.greatest(reach, x["end"])), F.when(is_term & (reach <= x["end"]), F.array(x["term"])).otherwise(F.array().cast(f"array<{kind}>"))

    return _scan(F.array_sort(F.concat(*rows)), F.lit(0), step, kind)


def _between(chunks: Column, begin: Column, end: Column) -> Column:
    """Characters from `begin` to `end` of a text that is cut into chunks of CHUNK: only those that hold them are walked."""
    places = F.sequence(F.floor(begin / CHUNK), F.floor((end - 1) / CHUNK))

    def part(k: Column) -> Column:
        low = F.greatest(begin - k * CHUNK, F.lit(0))
        return F.substr(chunks[k], (low + 1).cast("int"), (F.least(end - k * CHUNK, F.lit(CHUNK)) - low).cast("int"))

    return F.when(end > begin, F.array_join(F.transform(places, part), "")).otherwise("")


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """`text` with each span replaced; of overlapping spans the first wins. `by` is given the span, with the text there as `written`."""

    def replaced(chunks: Column) -> Column:
        last = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("by"))

        def full(x: Column) -> Column:
            written = _between(chunks, x["start"], x["end"])
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), by(x.withField("written", written)).alias("by"))

        order = F.array_append(F.array_sort(F.transform(spans, full)), last)

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            pieces = F.array(_between(chunks, at, x["start"]), F.coalesce(x["by"], F.lit("")))
            late = (x["start"] < at) & x["by"].isNotNull()
            return F.when(late, at).otherwise(x["end"]), F.when(late, F.array().cast("array<string>")).otherwise(pieces)

        return F.array_join(_scan(order, F.lit(0), step, "string"), "")

    return F.when(text.isNotNull(), _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), replaced))


def broader(value: Column) -> Column:
    """The class of what is written like a word: NUMBER (digits), CODE (digits and others), NAME (a capital first) or WORD."""
    first = value.substr(1, 1)
    return F.when(value.rlike("^[0-9]+$"), "NUMBER").when(value.rlike("[0-9]"), "CODE").when(first != F.lower(first), "NAME").otherwise("WORD")


def sanitise(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in brackets, a generalised term by its class; terms to remove leave nothing. Of overlapping spans the first wins."""

    def by(x: Column) -> Column:
        name = F.when(x["kind"] == "term", broader(x["written"])).otherwise(F.upper(x["kind"]))
        return F.when(x["action"] == "remove", "").otherwise(F.concat(F.lit("["), name, F.lit("]")))

    return _replaced(text, spans, by)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with counts and spans; null and empty texts have none, repeated rows have the same."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != "term")
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
