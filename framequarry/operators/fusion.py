"""Fusion of ranked lists, within an engine and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rrf_fuse(sparse: DataFrame, dense: DataFrame, key: str = "video_id", k: int = 60) -> DataFrame:
    """Full outer join of (key, sparse_rank, sparse_score) and (key, dense_rank, dense_score): score = sum of 1 / (k + rank)."""
    share = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    return sparse.join(dense, key, "full_outer").withColumn("score", share("sparse_rank") + share("dense_rank"))


def fused_order(key: str = "video_id", score: Column | None = None) -> list[Column]:
    """Best score first; of equals the lower dense score (none and 0 count as -1), then the larger sparse rank, then the key."""
    return [(F.col("score") if score is None else score).desc(), F.coalesce(F.nullif(F.col("dense_score"), F.lit(0.0)), F.lit(-1.0)).asc(), F.coalesce(F.nullif(F.col("sparse_rank"), F.lit(0)), F.lit(10000)).desc(), F.col(key).asc()]


def federate(sources: list[tuple[str, DataFrame]], key: str = "video_id", texts: tuple[str, ...] = ("video_path", "description", "caption"), arrays: tuple[str, ...] = ("tags",)) -> DataFrame:
    """Hits of several sources: scores add up, ranks take the least, raw scores the largest, texts the first non-empty in source order."""
    out = None
    for pos, (name, hits) in enumerate(sources):
        one = hits.withColumns({"__pos": F.lit(pos), "__source": F.lit(name)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    first = lambda c, full: F.min_by(F.col(c), F.when(full, F.col("__pos"))).alias(c)
    have = set(out.columns)
    return out.groupBy(key).agg(
        F.sum("score").alias("score"), *[F.min(c).alias(c) for c in ("sparse_rank", "dense_rank") if c in have], *[F.max(c).alias(c) for c in ("sparse_score", "dense_score") if c in have],
        *[first(c, F.coalesce(F.col(c), F.lit("")) != "") for c in texts if c in have], *[first(c, F.size(c) > 0) for c in arrays if c in have],
        F.array_sort(F.collect_set("__source")).alias("sources"), *([F.min_by("segments", "__pos").alias("segments")] if "segments" in have else []),
    ).withColumn("source_profile", F.element_at("sources", 1))
