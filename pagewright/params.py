"""Constants and the two semantic profiles of the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Multiplier of a posting by the rank of its tag (0 untagged, 1 title, 2-5 h1-h4, 6 b,
# 7 strong, 8 mark).
IMPORTANCE = (0.8, 3.5, 2.5, 2.1, 1.6, 1.3, 1.1, 1.1, 1.0)
# The tags that make text important, in order of rank.
IMPORTANT_TAGS = ("title", "h1", "h2", "h3", "h4", "b", "strong", "mark")


@dataclass(frozen=True)
class Params:
    """Weights and switches of a search.

    ``compat`` computes what a search engine of this kind is observed to compute, oddities included:
    no tag importance in postings, idf from the result set, first tokens of buckets and tokens outside
    ASCII out of reach, HITS authorities from out-links. ``intended`` has none of these.
    """

    profile: str = "compat"
    importance: tuple[float, ...] = IMPORTANCE
    relevance_weight: float = 0.61
    tfidf_weight: float = 0.73
    pagerank_weight: float = 0.59
    hub_weight: float = 0.23
    authority_weight: float = 0.18
    cosine_gate: float = 0.4
    junk_factor: float = 2.0
    stopword_share: float = 0.4
    damping: float = 0.85
    iterations: int = 25
    tolerance: float = 1e-6
    hamming: int = 3
    window: int = 200
    #: Read HTML with the full parser instead of regular expressions.
    parser: bool = False

    def __post_init__(self) -> None:
        if self.profile not in ("compat", "intended"):
            raise ValueError(f"unknown profile {self.profile}")
        if abs(self.pagerank_weight + self.hub_weight + self.authority_weight - 1) > 1e-5:
            raise ValueError("quality weights must add up to 1")

    @property
    def compat(self) -> bool:
        return self.profile == "compat"

    def with_profile(self, profile: str) -> Params:
        return replace(self, profile=profile)


COMPAT = Params()
INTENDED = Params(profile="intended")
