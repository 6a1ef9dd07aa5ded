"""Landed inputs: JSON snapshots with a declared schema, feeds, and pages with embedded records."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.text import decode_entities
from tidemark.functions.urls import PLATFORM_HOSTS, handle, host, platform_of
from tidemark.sources import nested

#: Fixed names of fields that name and describe an entity in foreign records.
NAME_FIELDS, URL_FIELDS, TAGLINE_FIELDS = ("name", "companyName", "title"), ("website", "websiteUrl", "url"), ("tagline", "oneLiner", "one_liner", "description")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, *, multi_line: bool = True) -> DataFrame:
    """Rows of the schema; an empty table where there is no such path, nulls where a record does not fit."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], spark.createDataFrame([], schema).schema)


def unnest(snapshot: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array of structs, with its place as `ordinal`."""
    return snapshot.select(F.posexplode(column).alias("ordinal", "_x")).select("ordinal", "_x.*")


def unpivot_links(rows: DataFrame, key: str, links: str) -> DataFrame:
    """key, platform and url of a map of links, without empty ones."""
    return rows.select(key, F.explode(links).alias("platform", "url")).filter(F.coalesce("url", F.lit("")) != "")


def platform_links(rows: DataFrame, key: str, links: str) -> DataFrame:
    """key, platform, url and handle of a map of links whose host is one of the platform's own; platforms without hosts of their own take any."""
    each = unpivot_links(rows, key, links)
    known, of = F.col("platform").isin(*PLATFORM_HOSTS), platform_of(F.col("url"))
    return each.filter(host(F.col("url")).isNotNull() & (~known | F.coalesce(of == F.col("platform"), F.lit(False)))).withColumn("handle", handle(F.col("platform"), F.col("url")))


def feed_items(pages: DataFrame, xml: str = "html") -> DataFrame:
    """`pages` without the text, a row for each RSS item or Atom entry: title, link, published, summary."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<(?:{name})[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</(?:{name})>", 1), "<[^>]+>", " "))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("item", r"(?is)<link[^>]*href=\"([^\"]+)\"", 1), F.lit("")))
    rows = pages.select(*[c for c in pages.columns if c != xml], F.explode(items).alias("item"))
    return rows.select("*", tag("title").alias("title"), link.alias("link"), tag("pubDate|published|updated").alias("published"), tag("description|summary|content").alias("summary")).drop("item")


def embedded_records(pages: DataFrame, key: str, source: str = "html") -> DataFrame:
    """key, ordinal, name, url, tagline of records that pages embed as JSON, in scripts and then in data-page attributes, at any depth. What is no JSON is passed over."""
    scripts = F.regexp_extract_all(source, F.lit(r"(?is)<script[^>]*type=[\"']application/(?:ld\+)?json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    attributes = F.transform(F.regexp_extract_all(source, F.lit(r"(?is)\sdata-page=\"([^\"]*)\""), F.lit(1)), decode_entities)
    bodies = F.filter(F.transform(F.concat(scripts, attributes), F.try_parse_json), lambda x: x.isNotNull())
    walked = nested.walk(pages.select(key, F.to_variant_object(bodies).alias("_json")), key, "_json")
    return nested.entity_records(walked, key, NAME_FIELDS, URL_FIELDS, TAGLINE_FIELDS)


def card_records(pages: DataFrame, key: str, pattern: str, source: str = "html") -> DataFrame:
    """key, ordinal, url and name of anchors whose address matches a pattern; the fallback where nothing is embedded."""
    anchors = F.regexp_extract_all(source, F.lit(r"(?is)<a\s[^>]*href=\"[^\"]+\"[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(key, F.posexplode(anchors).alias("ordinal", "a"))
    url, name = F.regexp_extract("a", r"(?is)href=\"([^\"]+)\"", 1), F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]+>", " "), r"\s+", " "))
    return rows.select(key, "ordinal", url.alias("url"), name.alias("name")).filter(F.col("url").rlike(pattern) & (F.col("name") != ""))


#: Fixed order of places where a page names its picture.
PREVIEW = (
    ("og", 90, r"(?is)<meta[^>]+property=\"og:image(?:[^\"]*)\"[^>]+content=\"([^\"]+)\""), ("twitter", 80, r"(?is)<meta[^>]+name=\"twitter:image\"[^>]+content=\"([^\"]+)\""),
    ("json_ld", 70, r"(?is)\"image\"\s*:\s*\"(https?:[^\"]+)\""), ("image", 40, r"(?is)<img[^>]+src=\"([^\"]+)\""), ("icon", 10, r"(?is)<link[^>]+rel=\"(?:shortcut )?icon\"[^>]+href=\"([^\"]+)\""),
)


def link_previews(pages: DataFrame, key: str, source: str = "html", limit: int = 5) -> DataFrame:
    """key, rank, origin and image: candidates by place, then order on the page; logos and pixels last. Relative addresses stay as they are."""
    found = [F.transform(F.regexp_extract_all(source, F.lit(p), F.lit(1)), _candidate(origin, score)) for origin, score, p in PREVIEW]
    ranked = F.slice(F.array_sort(F.concat(*found)), 1, limit)
    return pages.select(key, F.posexplode(ranked).alias("rank", "c")).select(key, (F.col("rank") + 1).alias("rank"), F.col("c.origin").alias("origin"), F.col("c.image").alias("image"))


def _candidate(origin: str, score: int):
    def make(image, place):
        poor = F.lower(image).rlike("logo|pixel|sprite|avatar|1x1")
        return F.struct((F.when(poor, 60).otherwise(0) - score).alias("order"), place.alias("place"), F.lit(origin).alias("origin"), image.alias("image"))

    return make


def search_records(results: DataFrame, batch: str) -> DataFrame:
    """`results` (title, snippet, url) that speak of the programme, with name (the title up to a sign that parts it) and reliability: medium on the programme's own pages that name the batch, else low."""
    own = F.contains("url", F.lit("ycombinator.com/companies"))
    speaks = F.concat_ws(" ", "title", "snippet", "url").rlike(r"(?i)y\s*combinator|yc\b")
    named = F.contains(F.regexp_replace(F.lower(F.concat_ws(" ", "title", "snippet")), "[^a-z0-9]", ""), F.lit(re.sub("[^a-z0-9]", "", batch.lower())))
    name = F.trim(F.regexp_extract("title", r"^([^|:–—]+?)(?:\s[|:–—-]\s.*|\s*[|:–—].*)?$", 1))
    rows = results.filter(speaks | own).withColumn("name", name).filter("name <> ''")
    return rows.withColumn("reliability", F.when(own & named, "medium").otherwise("low"))


def stories(hits: DataFrame) -> DataFrame:
    """`hits` (title, text) of a story search that name the batch."""
    return hits.filter(F.concat_ws(" ", "title", "text").rlike(r"(?i)\bYC\s*(P26|S26|Spring\s+2026)\b"))


def embedded_videos(pages: DataFrame, key: str, source: str = "html", most: int = 20) -> DataFrame:
    """key, place, video and title of the first videos, each once, in a page's embedded record."""
    found = F.regexp_extract_all(source, F.lit(r'(?s)("videoId":"[^"]+".{0,500}?"title":\{"runs":\[\{"text":"[^"]+")'), F.lit(1))
    each = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'^"videoId":"([^"]+)"', 1).alias("video"), F.regexp_extract(x, r'"text":"([^"]+)"$', 1).alias("title")))
    first = F.filter(each, lambda x, i: ~F.exists(F.slice(each, 1, i), lambda y: y["video"] == x["video"]))
    return pages.select(key, F.posexplode(F.slice(first, 1, most)).alias("place", "v")).select(key, "place", "v.*")


def drop_nulls(values: Column) -> Column:
    """A map without entries whose value is null."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def first_filled(sources: list[tuple[str, DataFrame]], expected: int | None = None) -> tuple[DataFrame, list[str]]:
    """The first source with rows, and warnings: which were empty, and a count that is not the expected one."""
    warnings = []
    for name, rows in sources:
        n = rows.count()
        if n:
            if expected is not None and n != expected:
                warnings.append(f"{name}: {n} rows, expected {expected}")
            return rows, warnings
        warnings.append(f"{name}: no rows")
    return sources[-1][1], warnings


def links_on_pages(pages: DataFrame, key: str, site: str, skip: str, source: str = "html", most: int = 6) -> DataFrame:
    """key, place and url of the first links of a page, each once, to a site (a host), without those whose path matches `skip`."""
    found = F.regexp_extract_all(source, F.lit(rf"(?i)href=[\"'](https?://(?:www\.)?{re.escape(site)}/[^\"'?#\s]+)"), F.lit(1))
    good = F.filter(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "/+$", ""))), lambda u: ~u.rlike(skip))
    return pages.select(key, F.posexplode(F.slice(good, 1, most)).alias("place", "url"))
