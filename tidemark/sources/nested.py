"""Nested JSON as rows: every value of a tree with its place, taken apart level by level with VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.media import PICTURE
from tidemark.session import durable

#: Keys of pictures.
PICTURE_KEYS = "(?i)thumbnail|poster|image|media|cover|og:image|twitter:image"


def kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY and so on, of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    """A string of a VARIANT, trimmed; null for anything else and for blanks."""
    return F.when(kind(value) == "STRING", F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))


def first_text(value: Column, names: tuple[str, ...]) -> Column:
    """The first string that is not blank among fields of an object, trimmed."""
    return F.coalesce(*[text_of(F.try_variant_get(value, f"$.{n}", "variant")) for n in names])


def texts_of(value: Column, names: tuple[str, ...] = ("name", "title")) -> Column:
    """The strings of a list, and of its objects the first of the fields; without blanks. Of anything but a list, none."""
    each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(kind(x) == "OBJECT", first_text(x, names)).otherwise(text_of(x)))
    return F.when(kind(value) == "ARRAY", F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def people_of(value: Column, names: tuple[str, ...] = ("name", "fullName", "full_name"), urls: tuple[str, ...] = ("url", "website")) -> Column:
    """Array of (name, url) of what names people: a list of strings or objects, or a string parted by commas or "and"."""
    person = lambda name, url: F.struct(name.alias("name"), url.alias("url"))
    none = F.lit(None).cast("string")
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(kind(x) == "OBJECT", person(first_text(x, names), first_text(x, urls))).otherwise(person(text_of(x), none)))
    parted = F.transform(F.split(text_of(value), ",| and "), lambda x: person(F.nullif(F.trim(x), F.lit("")), none))
    found = F.when(kind(value) == "ARRAY", listed).when(kind(value) == "STRING", parted)
    return F.coalesce(F.filter(found, lambda x: x["name"].isNotNull()), F.array().cast("array<struct<name:string,url:string>>"))


def walk(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, place, path, name and value of every value within the VARIANT column `value` of `rows`, itself included.

    place: the positions that lead to it, so sorting by it puts outer values
    before inner ones; objects lie by their keys. path: the keys on the way,
    null within lists. name: the last key, which elements of a list share. One
    pass for each level, over the values of that level alone; levels are written.
    """
    spark = rows.sparkSession
    none = F.lit(None).cast("string")
    level = durable(rows.select(key, F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("path"), none.alias("name"), F.col(value).alias("value")).filter("value IS NOT NULL"), "level")
    out = level
    while not level.isEmpty():
        inner = level.filter(kind(F.col("value")).isin("OBJECT", "ARRAY"))
        parts = inner.toDF("_key", "place", "path", "name", "_outer").lateralJoin(spark.tvf.variant_explode(F.col("_outer").outer()))
        place, path = F.concat("place", F.array(F.col("pos").cast("int"))), F.concat("path", F.array("key"))
        grown = parts.select(F.col("_key").alias(key), place.alias("place"), path.alias("path"), F.coalesce("key", "name").alias("name"), "value")
        level = durable(grown, "level")
        out = out.unionByName(level)
    return out


def leaves(walked: DataFrame) -> DataFrame:
    """Values that hold no others, as text."""
    inner = kind(F.col("value")).isin("OBJECT", "ARRAY")
    return walked.filter(~inner).withColumn("text", F.try_variant_get("value", "$", "string"))


def entity_records(walked: DataFrame, key: str, names: tuple[str, ...], urls: tuple[str, ...], taglines: tuple[str, ...]) -> DataFrame:
    """key, ordinal, name, url and tagline of the objects with a name and a URL or tagline, wherever they lie, outermost first, each once."""
    found = walked.filter(kind(F.col("value")) == "OBJECT").select(key, "place", *[first_text(F.col("value"), n).alias(c) for c, n in (("name", names), ("url", urls), ("tagline", taglines))])
    once = found.filter("name IS NOT NULL AND (url IS NOT NULL OR tagline IS NOT NULL)").groupBy(key, "name", "url", "tagline").agg(F.min("place").alias("place"))
    order = Window.partitionBy(key).orderBy("place")
    return once.select(key, (F.row_number().over(order) - 1).alias("ordinal"), "name", "url", "tagline")


def picture_urls(walked: DataFrame, key: str) -> DataFrame:
    """key, place and url of strings under a key of pictures, or that look like the address of one; each once, in order."""
    texts = walked.filter(kind(F.col("value")) == "STRING").select(key, "place", "name", F.try_variant_get("value", "$", "string").alias("url"))
    good = texts.filter((F.col("url") != "") & (F.coalesce(F.col("name").rlike(PICTURE_KEYS), F.lit(False)) | F.col("url").rlike(PICTURE)))
    once = good.groupBy(key, "url").agg(F.min("place").alias("place"))
    return once.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1).alias("place"), "url")
