"""Texts: normal forms, tokens, compact numbers, redaction, readable HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Words that tokens leave out.
STOP_WORDS = "and the for with that from into teams company builds gives".split()
#: Patterns of secrets, each with what takes its place.
SECRETS = (
    (r"gh[pousr]_[A-Za-z0-9_]{12,}", "[redacted-public-token]"),
    (r"github_pat_[A-Za-z0-9_]{12,}", "[redacted-public-token]"),
    (r"sk-[A-Za-z0-9_-]{12,}", "[redacted-public-token]"),
    (r"xox[baprs]-[A-Za-z0-9-]{12,}", "[redacted-public-token]"),
    (r"AKIA[0-9A-Z]{16}", "[redacted-public-token]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._-]{12,}", "Bearer [redacted-public-token]"),
    (r"\b([A-Za-z0-9_-]{3,})=[A-Za-z0-9%._/-]{16,}", "$1=[redacted-public-param]"),
)


#: What else is taken out of pages that were read while logged in; before the general rule for parameters.
COOKIES = ((r'(?i)\bJSESSIONID="[^"]+"', 'JSESSIONID="[redacted-cookie]"'), (r"(?i)\bli_at=[A-Za-z0-9%._/-]{16,}", "li_at=[redacted-cookie]"))


def redact(text: Column, cookies: bool = False) -> Column:
    rules = (*SECRETS[:-1], *COOKIES, SECRETS[-1]) if cookies else SECRETS
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def stable_id(text: Column) -> Column:
    return F.substring(slug(text), 1, 180)


def key_part(text: Column) -> Column:
    """Lower case, spaces collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+", " "))


def plain(text: Column) -> Column:
    """For attribution: no scheme, letters, digits and dots only."""
    low = F.lower(F.coalesce(text, F.lit("")))
    t = F.when(F.contains(low, F.lit("://")), F.regexp_replace(low, "https?://(www\\.)?", " ")).otherwise(low)
    return F.trim(F.regexp_replace(t, "[^a-z0-9.]+", " "))


def compact(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def searchable(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^@", ""), "https?://(www\\.)?", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text with no letter or digit at either end; both in `plain` or `searchable` form."""
    pattern = F.concat(F.lit("(^|[^a-z0-9])"), F.replace(phrase, F.lit("."), F.lit("\\.")), F.lit("([^a-z0-9]|$)"))
    return (F.length(phrase) > 0) & F.contains(text, phrase) & F.rlike(text, pattern)


def tokens(text: Column, stop: bool = True) -> Column:
    """Distinct tokens of over two letters or digits, without the stop words."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    drop = STOP_WORDS if stop else [""]
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(drop)))


def fingerprint(text: Column, first: int = 28) -> Column:
    """The first tokens of over two characters, without URLs."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", " ")
    parts = F.filter(F.split(F.regexp_replace(t, "[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 2)
    return F.array_join(F.slice(parts, 1, first), " ")


def compact_number(text: Column) -> Column:
    """1.2K, 3M, 4b, 1,234: as a whole number; null where the text is none."""
    t = F.trim(F.regexp_replace(text, ",", ""))
    number = F.try_to_number(F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBb]?)$", 1), F.lit("999999999999.999999")).cast("double")
    unit = F.lower(F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBb]?)$", 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.5).cast("long")


def compact_number_in(text: Column) -> Column:
    """The first compact number anywhere in a text: 12,345 followers, about 1.2K; null where there is none, or one that is no number (4.0.), has over 15 signs or six decimals."""
    pattern = r"([0-9.]+)\s*([KkMmBb])?"
    t = F.regexp_replace(text, ",", "")
    digits = F.regexp_extract(t, pattern, 1)
    number = F.when((F.length(digits) <= 15) & digits.rlike(r"^([0-9]+\.?|[0-9]*\.[0-9]{1,6})$"), digits).try_cast("double")
    unit = F.lower(F.regexp_extract(t, pattern, 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.5).cast("long")


def compact_label(n: Column) -> Column:
    """The reverse, with one decimal: 1234 to 1.2K."""
    one = lambda x: F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0$", "")
    return F.when(n >= 1e9, F.concat(one(n / 1e9), F.lit("B"))).when(n >= 1e6, F.concat(one(n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(one(n / 1e3), F.lit("K"))).otherwise(F.floor(n + 0.5).cast("string"))


def first_sentence(text: Column, most: int = 118) -> Column:
    found = F.regexp_extract(F.trim(text), r"^[^.!?\n]*[.!?]", 0)
    got = F.when(found == "", F.trim(text)).otherwise(found)
    return F.when(F.length(got) > most, F.concat(F.substring(got, 1, most - 1), F.lit("…"))).otherwise(got)


def decode_entities(text: Column) -> Column:
    """The common entities decoded, & last."""
    for entity, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def readable_html(page: Column) -> Column:
    """Text without scripts, styles and tags; the common entities decoded; spaces collapsed."""
    t = F.regexp_replace(page, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    t = decode_entities(F.regexp_replace(t, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def normal_query(text: Column) -> Column:
    """Query and failure patterns: quoted names and URLs as placeholders, 180 characters."""
    t = F.regexp_replace(F.regexp_replace(text, r'"[^"]+"', "{name}"), r"https?://[^ ]+", "{url}")
    return F.substring(F.trim(F.regexp_replace(t, "[ \t\r\n]+", " ")), 1, 180)


def clean(text: Column) -> Column:
    """Escaped ampersands decoded, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\u0026"), F.lit("&")), r"\s+", " "))


def without_links(text: Column) -> Column:
    """Markdown without pictures, and links as their words."""
    return F.regexp_replace(F.regexp_replace(clean(text), r"!\[[^\]]*\]\([^)]+\)", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")


def markdown_links(text: Column) -> Column:
    """Array of (label, url) of the links of a Markdown text, without pictures."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^!])(\[[^\]]+\]\(https?://[^)\s]+\))"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract(x, r"\((https?://[^)\s]+)\)$", 1).alias("url")))


def batch_slug(text: Column) -> Column:
    """YC Spring 2026, s 2026, Winter 2025: as S2026, W2025; else without spaces."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"^YC\s+", ""), r"\s+", " ")
    short, long = r"\b([SW])\s*(20[0-9]{2})\b", r"\b(SPRING|SUMMER|WINTER)\s+(20[0-9]{2})\b"
    season = F.when(F.regexp_extract(t, long, 1) == "WINTER", "W").otherwise("S")
    return F.when(t.rlike(short), F.concat(F.regexp_extract(t, short, 1), F.regexp_extract(t, short, 2))).when(t.rlike(long), F.concat(season, F.regexp_extract(t, long, 2))).otherwise(F.regexp_replace(t, " ", ""))


def batch_label(slug: Column) -> Column:
    """S2026 as Spring 2026, W2026 as Winter 2026."""
    n = batch_slug(slug)
    return F.when(n.rlike("^[SW]20[0-9]{2}$"), F.concat(F.when(F.startswith(n, F.lit("S")), "Spring ").otherwise("Winter "), F.substring(n, 2, 4))).otherwise(n)


def metric_pills(metrics: Column, order: list[str], most: int = 4) -> Column:
    """The first `most` positive metrics in the order, as label and compact number."""
    each = F.array(*[F.when(F.coalesce(metrics[k], F.lit(0.0)) > 0, F.concat_ws(" ", compact_label(metrics[k]), F.lit(k))) for k in order])
    return F.slice(F.filter(each, lambda x: x.isNotNull()), 1, most)


def post_text(text: Column, author: Column) -> Column:
    """A post's text as scraped, without controls of the page, what follows a relative time, and the author's name in front."""
    t = F.regexp_replace(clean(text), r"(?i)\b(see more|follow|like|comment|repost|send|feed post number [0-9]+)\b", " ")
    t = F.regexp_replace(t, r"(?i)\s[0-9]+\s?(m|h|d|w|mo|yr)\s?(ago|•|·).*$", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.trim(F.when(F.startswith(F.lower(t), F.lower(author)) & (F.length(author) > 0), F.substr(t, F.length(author) + 1)).otherwise(t))


def rolling_hash(text: Column, factor: int, modulus: int) -> Column:
    """(h * factor + code) mod modulus over the characters."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda h, c: ((h * factor + F.ascii(c)) % modulus).cast("int"))


def jitter(text: Column, width: float) -> Column:
    """A fixed displacement within half of `width` to either side."""
    return (rolling_hash(text, 33, 1009) / 1009.0 - 0.5) * width


#: Colours of groups without one of their own.
PALETTE = ("#F09EA7", "#F6CA94", "#FAFABE", "#C1EBC0", "#C7CAFF", "#CDABEB", "#F6C2F3")


def group_colour(name: Column, own: dict[str, str] | None = None) -> Column:
    key = F.lower(F.trim(name))
    other = F.element_at(F.array(*map(F.lit, PALETTE)), rolling_hash(key, 31, 9973) % len(PALETTE) + 1)
    mine = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[key] if own else F.lit(None).cast("string")
    return F.coalesce(mine, other)


def tag_set(industry: Column, industries: Column, path: Column, tags: Column) -> Column:
    """Distinct tags in lower case: the industry, the others, the parts of a path (a -> b), and tags."""
    all_ = F.concat(F.array(industry), industries, F.split(path, "->"), tags)
    return F.array_distinct(F.filter(F.transform(all_, lambda x: F.trim(F.lower(x))), lambda x: x != ""))
