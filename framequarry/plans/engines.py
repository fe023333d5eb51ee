"""Search engines: visual video search, hybrid text search, image search, each a composition of operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.config import HybridConfig, IndexConfig, RetrievalConfig, fetch_k, validate_request
from framequarry.operators import bm25, fusion, greedy, pooling, tables, temporal, topk
from framequarry.plans.encoders import TextEncoder, encode_column, query_vectors
from framequarry.session import materialise, spread
from framequarry.sources.files import manifest


@dataclass
class VideoEngine:
    """Coarse to fine: representative segments recall videos, segments are recalled within them, their frames reranked and merged."""

    frames: DataFrame  # frame_id, segment_id, video_id, ts, embedding
    segments: DataFrame  # segment_id, video_id, embedding, genericness, motion_score, is_representative
    config: RetrievalConfig = field(default_factory=RetrievalConfig)

    def recall_videos(self, queries: DataFrame) -> DataFrame:
        """(video_id, recall_score): the largest genericness-adjusted product of a query and a representative segment."""
        own = self.segments.filter("is_representative = 1")
        hits = topk.inner_product_topk(own, queries, self.config.video_recall, item="segment_id")
        hits = hits.join(own.select("segment_id", "video_id", "genericness"), "segment_id")
        adjusted = F.col("score") - self.config.genericness_penalty * F.coalesce("genericness", F.lit(0.0))
        return hits.groupBy("video_id").agg(F.max(adjusted).alias("recall_score")).orderBy(F.desc("recall_score"), "video_id").limit(self.config.video_pool)

    def recall_segments(self, queries: DataFrame, videos: DataFrame) -> DataFrame:
        """(segment_id, video_id, segment_score) within the recalled videos, or of any video if none is left."""
        hits = topk.inner_product_topk(self.segments, queries, self.config.segment_recall, item="segment_id")
        best = hits.groupBy("segment_id").agg(F.max("score").alias("segment_score")).join(self.segments.select("segment_id", "video_id"), "segment_id")
        return tables.candidates_or_all(best, videos, "video_id").orderBy(F.desc("segment_score"), "segment_id").limit(self.config.segment_pool)

    def rerank(self, queries: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(frame rows with clip_score and frame_score, (video_id, video_score))."""
        c = self.config
        own = self.frames.join(F.broadcast(candidates.select("segment_id")), "segment_id", "left_semi")
        vectors = queries.select(F.col("embedding").alias("query_vector"))
        scored = topk.inner_products(own, vectors).groupBy("frame_id").agg(F.max("ip").alias("clip_score"))
        rows = own.join(scored, "frame_id").join(self.segments.select("segment_id", "motion_score", "genericness"), "segment_id")
        support = pooling.consensus_top_k(rows, ["segment_id"], "clip_score", c.support_top_k, c, "support")
        generic = c.rerank_genericness_weight * F.coalesce("genericness", F.lit(0.0)) if c.rerank_genericness else F.lit(0.0)
        final = c.clip_weight * F.col("clip_score") + c.motion_weight * F.coalesce("motion_score", F.lit(0.0)) + c.segment_support_weight * F.coalesce("support", F.lit(0.0)) - generic
        rows = rows.join(support, "segment_id", "left").withColumn("frame_score", final)
        return rows, pooling.consensus_top_k(rows, ["video_id"], "frame_score", c.rerank_top_k, c, "video_score")

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(video_id, score, segments), best first; queries: (query_id, embedding) of one request."""
        # lists bounded by the pools, written once: the steps after them read them several times
        candidates = materialise(self.recall_segments(queries, self.recall_videos(queries)), "candidates")
        frames = materialise(self.rerank(queries, candidates)[0], "reranked")
        scores = pooling.consensus_top_k(frames, ["video_id"], "frame_score", self.config.rerank_top_k, self.config, "video_score")
        hits = frames.select("video_id", "frame_id", "ts", F.col("frame_score").alias("score"), "embedding")
        found = temporal.best_intervals(temporal.intervals(hits, ["video_id"], "ts", "score", "frame_id", "embedding", self.config), ["video_id"], self.config.max_intervals)
        first = hits.groupBy("video_id").agg(F.max("score").alias("first"))
        out = found.join(scores, "video_id").join(first, "video_id").select("video_id", F.bround("video_score", 4).alias("score"), "segments", "first")
        return out.orderBy(F.desc("score"), F.desc("first"), "video_id").limit(top_k or self.config.result_videos).drop("first")


@dataclass
class HybridEngine:
    """BM25 and dense lists fused by reciprocal ranks."""

    docs: DataFrame  # video_id, tags, description, caption, video_path, embedding
    encoder: TextEncoder
    config: HybridConfig = field(default_factory=HybridConfig)
    key: str = "video_id"

    def __post_init__(self) -> None:
        fields = bm25.term_fields(self.docs, self.key, F.col("tags"), F.col("description"), F.col("caption"))
        self.index = bm25.build(fields, self.key)
        # searches read vectors, not texts, and don't encode anew
        self.vectors = materialise(self.docs.select(self.key, "embedding").filter("embedding is not null"), "vectors")

    def sparse(self, text: str, limit: int) -> DataFrame:
        spark = self.docs.sparkSession
        terms = bm25.query_rows(spark.createDataFrame([(0, text)], "query_id int, text string"), "text")
        hits = bm25.search(self.index, terms).drop("query_id")
        return topk.rank_list(hits, [F.asc("sparse_score"), F.asc(self.key)], limit, "sparse_rank")

    def dense(self, text: str, limit: int) -> DataFrame:
        spark = self.docs.sparkSession
        vector = [float(x) for x in query_vectors(self.encoder, [text])[0]]
        queries = spark.createDataFrame([(0, vector)], "query_id int, embedding array<double>")
        hits = topk.inner_product_topk(self.vectors, queries, limit, item=self.key)
        return hits.select(self.key, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))

    def search(self, text: str, top_k: int = 10, sparse_top_k: int | None = None, dense_top_k: int | None = None, rrf_k: int | None = None) -> DataFrame:
        """(key, score, ranks, raw scores, tags, description, caption), best first; a blank query finds nothing."""
        n_sparse, n_dense, k = self.config.limits(top_k, sparse_top_k, dense_top_k, rrf_k)
        fused = fusion.rrf_fuse(self.sparse(text, n_sparse), self.dense(text, n_dense), self.key, k)
        if not text.strip():
            fused = fused.limit(0)
        best = materialise(fused.orderBy(*fusion.fused_order(self.key)).limit(top_k), "fused")
        found = self.docs.drop("embedding").join(F.broadcast(best.select(self.key)), self.key, "left_semi")  # at most top_k
        return best.join(found, self.key, "left").orderBy(*fusion.fused_order(self.key))


def federated_search(engines: list[tuple[str, HybridEngine]], text: str, top_k: int = 10) -> DataFrame:
    """One engine's result as it is, or those of several merged."""
    if len(engines) == 1:
        return engines[0][1].search(text, top_k)
    key = engines[0][1].key
    merged = fusion.federate([(n, e.search(text, top_k)) for n, e in engines], key)
    return merged.orderBy(*fusion.fused_order(key)).limit(top_k)


@dataclass
class PictureEngine:
    """Images by vector, with content duplicates suppressed, or by attributes and vector without."""

    images: DataFrame  # image_id, path, md5, embedding and attributes
    dedup: str = "md5"

    def search(self, queries: DataFrame, top_k: int = 10, filters: dict[str, str | None] | None = None, threshold: float = 0.99) -> DataFrame:
        """(query_id, image_id, score, rank, path) for each of a few query vectors."""
        validate_request("vector", top_k)
        if filters and tables.filters_active(filters):
            own = tables.attribute_filter(self.images, filters, F.col("embedding").isNotNull())
            hits = topk.inner_product_topk(own, queries, top_k, item="image_id")
        else:
            n = fetch_k(top_k, self.images.filter("embedding is not null").count())
            hits = topk.inner_product_topk(self.images, queries, max(1, n), item="image_id").drop("rank")
            full = hits.join(self.images.select("image_id", "md5", "embedding"), "image_id")
            if self.dedup == "md5":
                hits = topk.ranked(greedy.first_per_content(full, "md5", "score", "image_id", ["query_id"]).select("query_id", "image_id", "score"), ["query_id"], [F.desc("score"), F.asc("image_id")], top_k)
            else:
                hits = greedy.suppress_near(full, ["query_id"], "image_id", "score", "embedding", threshold, top_k)
        return tables.lookup(hits.select("query_id", "image_id", "score", "rank"), self.images.select("image_id", "path"), "image_id")


def dual_compare(left: DataFrame, right: DataFrame, key: str = "image_id") -> DataFrame:
    """Two engines' ranked hits side by side: (key, left_rank, right_rank, left_score, right_score, in_both)."""
    a = left.select(key, F.col("rank").alias("left_rank"), F.col("score").alias("left_score"))
    b = right.select(key, F.col("rank").alias("right_rank"), F.col("score").alias("right_score"))
    return a.join(b, key, "full_outer").withColumn("in_both", F.col("left_rank").isNotNull() & F.col("right_rank").isNotNull())


def build_segments(frames: DataFrame, keys: tuple[str, str] = ("video_id", "segment_id"), seconds: float | None = None) -> DataFrame:
    """Segments of frames (video_id, segment_id, frame_id, ts, embedding, norm): pooled vector, importance, genericness, representatives.

    A segment lasts from segment_start to segment_stop where frames have those, else ``seconds`` (the configured length).
    """
    seconds = IndexConfig().segment_seconds if seconds is None else seconds
    bounds = {"segment_start", "segment_stop"} <= set(frames.columns)
    length = F.col("segment_stop") - F.col("segment_start") if bounds else F.lit(float(seconds))
    own = list(keys)
    pooled = pooling.mean_pool(frames, own, "embedding")
    scores = pooling.segment_importance(frames.withColumn("__len", length), own, "embedding", "norm", "ts", "__len")
    out = pooled.join(scores, own).join(pooling.genericness(pooled, "segment_id", "embedding"), "segment_id")
    chosen = greedy.representatives(out, ["video_id"], "segment_id", "importance", "genericness", "embedding")
    return out.join(chosen.withColumnRenamed("rank", "representative_rank"), own, "left").withColumn("is_representative", F.col("representative_rank").isNotNull().cast("int"))


def refresh_representatives(segments: DataFrame) -> DataFrame:
    """Segments with genericness taken anew over all of them, and the representatives of each video chosen anew."""
    own = segments.drop("genericness", "representative_rank", "is_representative")
    out = own.join(pooling.genericness(own, "segment_id", "embedding"), "segment_id", "left")
    chosen = greedy.representatives(out, ["video_id"], "segment_id", "importance", "genericness", "embedding")
    out = out.join(chosen.withColumnRenamed("rank", "representative_rank"), ["video_id", "segment_id"], "left")
    return out.withColumn("is_representative", F.col("representative_rank").isNotNull().cast("int"))


def index_tables(frames: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """The three vector indexes (item_id, embedding): of frames, of segments, and of videos' representative segments (video::segment)."""
    vector = F.col("embedding").isNotNull()
    item = F.concat_ws("::", F.col("video_id").cast("string"), "segment_id").alias("item_id")
    return {
        "vectors_frame": frames.filter(vector).select(F.col("frame_id").cast("string").alias("item_id"), "embedding"), "vectors_segment": segments.filter(vector).select(F.col("segment_id").alias("item_id"), "embedding"),
        "vectors_video": segments.filter(vector & (F.coalesce("is_representative", F.lit(0)) == 1)).select(item, "embedding"),
    }


def representations(segments: DataFrame) -> DataFrame:
    """Stored segments as a build hands them on: the segment's norm is its norm score."""
    score = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return segments.select("video_id", "segment_id", "embedding", F.coalesce("embedding_norm", F.lit(0.0)).alias("embedding_norm_score"), *[score(c) for c in ("importance_score", "motion_score", "visual_diversity_score", "genericness_score") if c in segments.columns])


def refresh_documents(docs: DataFrame, encoder: TextEncoder, text: Column, captioned: str = "caption_updated_at", embedded: str = "embedding_updated_at", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with the vectors of stale and new ones encoded anew, and one row about the build.

    Only those rows are encoded; the others keep their vector and its time.
    """
    stale, fresh = stale_or_new(docs, F.col("embedding").isNotNull(), captioned, embedded)
    when = (F.current_timestamp() if now is None else now).cast(docs.schema[embedded].dataType)
    encoded = materialise(embed_documents(stale.drop("embedding"), encoder, text).withColumn(embedded, when).select(*docs.columns), "encoded")
    encoded = encoded.withColumn("embedding", F.col("embedding").cast(docs.schema["embedding"].dataType.simpleString()))
    return fresh.unionByName(encoded), manifest(docs, encoded, "full" if encoded.limit(1).count() else "noop", 0)


def stale_or_new(docs: DataFrame, has_vector: Column, captioned: str, embedded: str) -> tuple[DataFrame, DataFrame]:
    """Rows that need encoding, and those that don't."""
    need = ~has_vector | F.coalesce(F.col(captioned) > F.col(embedded), F.lit(False))
    return docs.filter(need), docs.filter(~need)


def embed_documents(docs: DataFrame, encoder: TextEncoder, text: Column) -> DataFrame:
    return spread(docs).withColumn("embedding", encode_column(text, encoder))
