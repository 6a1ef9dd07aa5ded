"""Results that once differed from their SQL on larger tables."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import attribution, graph, scoring
from tidemark.operators.config import Scoring


def test_means_do_not_hang_on_how_rows_lie(spark):
    for rows in permutations([(1, 1, 1e16), (1, 2, 1.0), (1, 3, -1e16), (1, 4, None)]):
        df = spark.createDataFrame(list(rows), "user long, id long, value double").coalesce(1)
        assert scoring.mean_in_order(df, "user", "value", "id").first()["mean"] == 0.0


@pytest.mark.parametrize(("given", "want"), [("CC BY-NC 4.0. Then 5K", None), ("in 4.", 4), ("12,345 followers", 12345), ("about .5k", 500), ("no. 3", None), ("card 1234567890.123456", None), ("3.14159265", None), ("1.2 m", 1200000)])
def test_first_number_of_a_text(spark, given, want):
    assert spark.range(1).select(text.compact_number_in(F.lit(given)).alias("v")).first()["v"] == want


def test_ties_of_weighed_platforms_are_exact(spark):
    """85 * 0.5 + 86 * 0.1 + 81 * 0.3 + 91 * 0.1 is 84.5."""
    config = Scoring(platform_weights={"x": 0.1, "instagram": 0.1, "github": 0.5, "linkedin": 0.3})
    for rows in permutations([(1, "github", 1, 85.0), (1, "instagram", 1, 86.0), (1, "linkedin", 1, 81.0), (1, "x", 1, 91.0)]):
        df = spark.createDataFrame(list(rows), "entity_id long, platform string, n long, platform_score double").coalesce(1)
        assert scoring.entity_scores(df, config).first()["total"] == 85


@pytest.mark.parametrize(("bio", "want"), [("we build acme-works2026", False), ("acme works 2026", False), ("(YC S2026)", True), ("yc s 2026 team", True), ("YCS2026", True), (None, False)])
def test_a_batch_begins_with_a_word(spark, bio, want):
    row = dict.fromkeys(("explicit", "display_name", "handle", "site", "website", "verified", "on_official_site"))
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in row.items() if k not in ("verified", "on_official_site")], F.lit(False).alias("verified"), F.lit(False).alias("on_official_site"),
        F.lit("company").alias("entity_type"), F.lit("Acme").alias("name"), F.lit("Acme").alias("company_name"), F.lit("S2026").alias("batch"), F.lit(bio).cast("string").alias("bio"), F.lit(None).cast("timestamp").alias("active_at"))
    assert attribution.identity_signals(df, F.lit("2026-06-01")).first()["batch_context"] is want


def test_compact_ids_beyond_four_digits(spark):
    """36**4 places have four digits; the next ones have five and are not those of the first again."""
    ids = graph.compact_ids(spark.range(1679610, 1679620), "ev-", "id").count()
    digits = graph.compact_ids(spark.range(0, 1679618), "ev-", "id").filter("id >= 1679615").select("compact_id").collect()
    assert ids == 10 and sorted(d[0] for d in digits) == ["ev-10000", "ev-10001", "ev-zzzz"]
