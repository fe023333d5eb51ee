"""Default parameters of recall, rerank, fusion, index building and deduplication."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalConfig:
    video_recall: int = 64
    segment_recall: int = 64
    video_pool: int = 128
    segment_pool: int = 128
    genericness_penalty: float = 0.1
    clip_weight: float = 0.85
    motion_weight: float = 0.1
    segment_support_weight: float = 0.2
    rerank_genericness_weight: float = 0.05
    rerank_genericness: bool = False
    rerank_top_k: int = 3
    support_top_k: int = 3
    rerank_beta: float = 10.0
    support_floor: float = 0.18
    support_bonus: float = 0.08
    spike_penalty: float = 0.06
    merge_gap: float = 2.0
    temporal_threshold: float = 0.9
    interval_top_k: int = 3
    interval_beta: float = 12.0
    interval_score_weight: float = 0.7
    interval_consistency_weight: float = 0.3
    max_intervals: int = 3
    result_videos: int = 5

    def override(self, **given) -> RetrievalConfig:
        """A copy with the given parameters; None keeps the default."""
        known = {f.name for f in fields(self)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class HybridConfig:
    sparse_top_k: int = 100
    dense_top_k: int = 100
    rrf_k: int = 60

    def limits(self, top_k: int, sparse: int | None = None, dense: int | None = None, rrf_k: int | None = None) -> tuple[int, int, int]:
        return max(top_k, sparse or self.sparse_top_k), max(top_k, dense or self.dense_top_k), max(1, rrf_k or self.rrf_k)


@dataclass(frozen=True)
class IndexConfig:
    segment_seconds: float = 4.0
    frames_per_second: float = 2.0
    frames_per_segment: int = 4
    dedupe_threshold: float = 0.98
    min_side: int = 128
    representatives: int = 8
    genericness_weight: float = 0.35
    diversity_weight: float = 0.25
    kmeans_rounds: int = 12
    incremental_limit: int = 50


def validate_request(query: str, top_k: int = 10, **limits: int | None) -> None:
    """Raise ValueError unless the request is one the engines accept."""
    if not query:
        raise ValueError("query must not be empty")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    for name, value in limits.items():
        if value is not None and not 1 <= value <= 500:
            raise ValueError(f"{name} must be between 1 and 500")


def fetch_k(top_k: int, total: int) -> int:
    """How many hits to fetch so that top_k remain after deduplication."""
    return 0 if total <= 0 or top_k <= 0 else min(total, max(top_k, top_k * 5, top_k + 40))
