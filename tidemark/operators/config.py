"""Parameters of the scoring models, replaceable in part through dataclasses.replace."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, functions as F


def lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    got = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key] if values else F.lit(None).cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


@dataclass(frozen=True)
class Scoring:
    """Fixed values of the live model: weights of platforms and metrics, half-lives in days."""

    platform_weights: dict[str, float] = field(default_factory=lambda: {"x": 0.34, "instagram": 0.22, "github": 0.14, "linkedin": 0.14, "product_hunt": 0.07, "youtube": 0.05, "hacker_news": 0.04})
    metric_weights: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "github": {"stars": 1.5, "forks": 4, "watchers": 2, "issues": 0.5, "open_issues": 0.5, "recent_commits_30d": 1},
            "x": {"views": 0.08, "likes": 1.5, "replies": 5.5, "comments": 5.5, "reposts": 8, "shares": 8, "quotes": 8},
            "linkedin": {"views": 0.08, "likes": 1.5, "reactions": 1.5, "comments": 5.5, "reposts": 8, "shares": 8},
            "instagram": {"views": 0.075, "likes": 1.1, "comments": 5, "shares": 5, "reposts": 5, "saves": 5},
            "product_hunt": {"upvotes": 2, "comments": 3},
            "hacker_news": {"upvotes": 2, "comments": 3},
            "reddit": {"upvotes": 2, "comments": 3},
            "youtube": {"views": 0.035, "likes": 1, "comments": 3},
            "bilibili": {"views": 0.035, "likes": 1, "comments": 3, "shares": 4},
            "web": {},
            "rss": {},
        }
    )
    half_lives: dict[str, float] = field(default_factory=lambda: {"github": 180, "product_hunt": 90, "youtube": 120, "linkedin": 60, "instagram": 45, "x": 45, "hacker_news": 45, "reddit": 45})
    default_half_life: float = 60.0
    unscored: tuple[str, ...] = ("web", "rss")
    view_heavy: tuple[str, ...] = ("x", "instagram", "linkedin", "youtube", "bilibili")
    fallback_platform: str = "x"

    def weight(self, platform: Column) -> Column:
        return lookup({k: float(v) for k, v in self.platform_weights.items()}, platform)

    def half_life(self, platform: Column) -> Column:
        return lookup({k: float(v) for k, v in self.half_lives.items()}, platform, self.default_half_life)


LIVE = Scoring()
#: Fixed values of the library and of the demonstration model: weights of metrics, and of six platforms.
LIBRARY_METRICS = {
    "likes": 1, "comments": 3, "shares": 4, "reposts": 4, "replies": 3, "quotes": 4, "reactions": 1, "saves": 4, "views": 0.02, "upvotes": 2, "stars": 1.5,
    "forks": 4, "watchers": 2, "issues": 0.5, "openIssues": 0.5, "discussions": 2, "productHuntUpvotes": 2, "productHuntComments": 3,
}
DEMO_METRICS = {"likes": 1, "comments": 3, "shares": 4, "reposts": 4, "saves": 4, "views": 0.05, "upvotes": 1.5, "stars": 2, "forks": 4, "issues": 2}
LIBRARY_PLATFORMS = {"x": 0.25, "linkedin": 0.15, "instagram": 0.15, "product_hunt": 0.15, "github": 0.20, "youtube": 0.10}
