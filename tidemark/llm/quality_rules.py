"""Quality rules combined by weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns, of which there are
3 to the number of rules at most, estimates how often each rule votes how on
good and on bad documents; a document is kept where the posterior probability
of good quality reaches a half. Everything is DataFrame expressions: documents are scored where they
lie, and each round of the estimation is one aggregate over the patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.tables import table
from tidemark.session import durable

SPACES = r"[\x20\x09-\x0D]+"
#: Frequent function words of the corpus languages.
FUNCTION_WORDS = """the of and to in is that it was for on are as with be at by or from this
der die das und ist von zu den mit nicht ein eine auf für sich
de la le les et des est un une en que dans pour
el los las y se por del con una""".split()
#: The estimation ends when no share moves by more than this.
TOLERANCE = 1e-4
#: What is believed before any vote: the share of good documents, and of votes (-1, 0, 1) on good and on bad ones; it weighs as many documents.
PRIOR_GOOD = 0.85
PRIOR_VOTES = {True: (0.02, 0.28, 0.7), False: (0.4, 0.3, 0.3)}
PRIOR_WEIGHT = 20.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def features(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_digits, n_function_words and n_shouts.

    Whole texts; null counts as empty. Three-word windows are compared by
    64-bit hashes within their text. Columns of `docs` with these names are
    replaced; `keep_good` keeps its rows whole beside them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    out = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    at = lambda i: F.get("_words", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))
    out = out.withColumn("_windows", F.when(F.size("_words") >= 3, F.sort_array(windows)))
    same = lambda i, j: F.get("_windows", i)["h"] == F.get("_windows", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_windows") - 1), lambda j: F.coalesce(F.when(j > 0, same(j, j - 1)), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    out = out.withColumn("_twice", F.when(F.col("_windows").isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get("_windows", j)["p"]))))
    covered = F.transform("_twice", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_twice", j + 1), p + 3) - p).cast("long"))
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
        "n_function_words": F.size(F.filter("_words", lambda w: w.isin(FUNCTION_WORDS))).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
    }).drop("_words", "_lines", "_windows", "_twice")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, as expressions over `features`."""
    n, c = F.col("n_words"), F.col
    return {
        "word_length": vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 8 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)),
        "symbols": vote(c("n_symbols") == 0, 10 * c("n_symbols") > n),
        "dup_lines": vote((c("n_dup_lines") == 0) & (c("n_lines") > 1), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": vote(100 * c("n_repeat_words") <= 5 * n, 100 * c("n_repeat_words") > 30 * n),
        "length": vote(n >= 100, n < 50),
        "digits": vote(100 * c("n_digits") <= 3 * c("word_chars"), 100 * c("n_digits") > 15 * c("word_chars")),
        "function_words": vote(100 * c("n_function_words") >= 8 * n, 100 * c("n_function_words") < n),
        "shouting": vote(c("n_shouts") == 0, 10 * c("n_shouts") > n),
    }


Accuracy = list[dict[bool, tuple[float, ...]]]


def posterior(votes: list[Column], accuracy: Accuracy, prior: float) -> Column:
    """The probability of good quality given the votes, by rule the shares of votes on good (True) and bad (False) documents."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, a in zip(votes, accuracy, strict=True):
        against, none, for_ = (math.log(g / b) for g, b in zip(a[True], a[False], strict=True))
        odds = odds + F.when(v == 1, for_).when(v == -1, against).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str]) -> tuple[Accuracy, float]:
    """Shares of votes of each rule and the share of good documents, by expectation-maximisation.

    patterns: a row for each vote pattern with its count `n`. Each round sends
    four sums a rule to the driver. No round makes the estimate less likely, so
    moves die out, and rounds go on until none exceeds TOLERANCE. Without rows
    the prior beliefs stay.
    """
    accuracy: Accuracy = [dict(PRIOR_VOTES) for _ in names]
    prior = PRIOR_GOOD
    while True:
        good = F.col("n") * F.col("q")
        sums = [F.sum(F.when(F.col(c) == v, x)) for c in names for x in (good, F.col("n") - good) for v in (-1, 1)]
        got = patterns.withColumn("q", posterior([F.col(c) for c in names], accuracy, prior)).agg(F.sum("n"), F.sum(good), *sums).first()
        if not got[0]:
            break
        count = {True: got[1], False: got[0] - got[1]}
        new: Accuracy = []
        for k in range(len(names)):
            of = {}
            for j, y in enumerate((True, False)):
                votes = [got[2 + 4 * k + 2 * j] or 0.0, 0.0, got[3 + 4 * k + 2 * j] or 0.0]
                votes[1] = count[y] - votes[0] - votes[2]
                of[y] = tuple((max(v, 0.0) + PRIOR_WEIGHT * p) / (count[y] + PRIOR_WEIGHT) for v, p in zip(votes, PRIOR_VOTES[y], strict=True))
            new.append(of)
        share = (got[1] + PRIOR_WEIGHT * PRIOR_GOOD) / (got[0] + PRIOR_WEIGHT)
        moved = max([abs(share - prior), *(abs(x - y) for a, b in zip(new, accuracy, strict=True) for g in (True, False) for x, y in zip(a[g], b[g], strict=True))])
        accuracy, prior = new, share
        if moved < TOLERANCE:
            break
    return accuracy, prior


def vote_patterns(scored: DataFrame) -> tuple[DataFrame, list[str]]:
    votes = rules()
    counts = scored.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).agg(F.count("*").alias("n"))
    return durable(counts.coalesce(1), "votes"), list(votes)


def verdict(scored: DataFrame, accuracy: Accuracy, prior: float) -> DataFrame:
    """`scored` with base_failed, quality (the posterior) and kept."""
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return scored.withColumn("base_failed", failed).withColumn("quality", posterior(list(rules().values()), accuracy, prior)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns only.

    Null and empty texts fail for want of words; repeated rows share a verdict;
    an empty table stays empty. Columns of `docs` named as a feature are set
    aside meanwhile.
    """
    plain = docs.select(F.struct("*").alias("_row"), F.col("text"))
    # Written once: what follows needs the features twice, and they cost far more than the rows take to read.
    scored = durable(features(plain).drop("text"), "features")
    patterns, names = vote_patterns(scored)
    accuracy, prior = fit(patterns, names)
    return verdict(scored, accuracy, prior).filter("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their features, base_failed, the verdict and the posterior; null and empty texts fail, repeated rows share a verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = durable(features(docs).drop("text"), "features")
    patterns, names = vote_patterns(scored)
    accuracy, prior = fit(patterns, names)
    return verdict(scored, accuracy, prior).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE: dict[str, str] = {}
