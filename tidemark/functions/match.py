"""Matching of short strings: similarity by edits, and tiers of search scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.num import jround


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_score(query: Column, value: Column) -> Column:
    """Closeness in spite of typing errors, of texts in `searchable` form: 86 and up for nearly equal, down to 0."""
    whole = similarity(F.replace(query, F.lit(" "), F.lit("")), F.replace(value, F.lit(" "), F.lit("")))
    asked = F.filter(F.split(query, " "), lambda t: F.length(t) >= 3)
    have = F.filter(F.split(value, " "), lambda t: F.length(t) >= 3)
    best = F.transform(asked, lambda q: F.struct(q.alias("q"), F.array_max(F.transform(have, lambda v: similarity(q, v))).alias("s")))
    close = F.forall(best, lambda x: x["s"] >= F.when(F.length(x["q"]) <= 5, 0.58).otherwise(0.68))
    average = F.aggregate(best, F.lit(0.0), lambda n, x: n + x["s"]) / F.size(best)
    by_token = F.when((F.size(asked) > 0) & (F.size(have) > 0) & close & (average >= 0.68), 42 + jround(average * 24)).otherwise(0.0)
    out = F.when(whole >= 0.85, 86 + jround(whole * 10)).when(whole >= 0.78, 66 + jround(whole * 18)).otherwise(by_token)
    return F.when((F.length(query) < 3) | (F.length(value) < 3), 0.0).otherwise(out)


def match_score(query: Column, value: Column) -> Column:
    """Exact 100, prefix 82, contained 64, all tokens 48 and one for each, or the fuzzy score if that is more."""
    parts = F.split(query, " ")
    hits = F.size(F.filter(parts, lambda t: F.contains(value, t)))
    exact = F.when(value == query, 100.0).when(F.startswith(value, query), 82.0).when(F.contains(value, query), 64.0).when(hits == F.size(parts), 48.0 + hits).otherwise(0.0)
    return F.when(value == "", 0.0).otherwise(F.greatest(exact, fuzzy_score(query, value)))
