"""Filters, lookups, merges, incremental maintenance and the task ledger over plain tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- filters


def contains_ascii(field: Column | str, value: str) -> Column:
    """LIKE '%value%' with ASCII case folding; % and _ in the value are wildcards, nothing escapes them."""
    field = F.col(field) if isinstance(field, str) else field
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + value.translate(str.maketrans(upper, lower)) + "%"
    return F.translate(F.coalesce(field, F.lit("")), upper, lower).like(pattern.replace("\\", "\\\\"))


def attribute_filter(rows: DataFrame, filters: dict[str, str | None], ready: Column | None = None) -> DataFrame:
    """Rows that hold each non-blank filter value in its field."""
    out = rows if ready is None else rows.filter(ready)
    for field, value in filters.items():
        if value and value.strip():
            out = out.filter(contains_ascii(field, value.strip()))
    return out


def filters_active(filters: dict[str, str | None]) -> bool:
    return any(v and v.strip() for v in filters.values())


def needs_embedding(status: str, has_vector: Column, captioned: str, embedded: str) -> Column:
    """Captioned but not embedded, or done with no vector or one older than the caption; an unknown time isn't newer."""
    newer = F.coalesce(F.col(captioned) > F.col(embedded), F.lit(False))
    return (F.col(status) == "caption_done") | ((F.col(status) == "done") & (~has_vector | newer))


def should_skip(status: Column, overwrite: bool, retry_failed: bool) -> Column:
    """Whether a row with an earlier result is passed over."""
    if overwrite:
        return F.lit(False)
    return F.coalesce(status == "ok", F.lit(False)) | (status.isNotNull() & F.lit(not retry_failed))


def should_caption(status: Column, force: bool = False, retry_failed: bool = False) -> Column:
    """Whether an image is captioned: new and pending ones, interrupted ones; failed ones on request; all if forced."""
    if force:
        return F.lit(True)
    known = F.coalesce(status, F.lit("pending"))
    return F.when(known.isin("done", "caption_done"), False).when(known == "failed", F.lit(retry_failed)).otherwise(True)


def structured(description: str, tags: str) -> Column:
    return (F.trim(F.coalesce(description, F.lit(""))) != "") & (F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0)


def require_structured(rows: DataFrame, description: str, tags: str) -> DataFrame:
    """The rows as they are; raises if any of them has no description or no tags."""
    total, good = rows.agg(F.count("*"), F.count_if(structured(description, tags))).first()
    if good < total:
        raise ValueError(f"{total} records, {good} structured, {total - good} legacy")
    return rows


def select_videos(videos: DataFrame, key: str, ids: list[str] | None = None, first: int | None = None, last: int | None = None, limit: int = 0, done: DataFrame | None = None) -> DataFrame:
    """Whitelist, range of the trailing number, limit in key order, and only then those done before go."""
    from framequarry.functions.captions import video_index

    out = videos if ids is None else videos.join(listed(videos, key, ids).select(key), key, "left_semi")
    if first is not None:
        out = out.filter(video_index(key) >= first)
    if last is not None:
        out = out.filter(video_index(key) <= last)
    if limit > 0:
        out = out.orderBy(key).limit(limit)
    return out if done is None else out.join(done.select(key), key, "left_anti")


# ---- joins


def frames_with_parents(frames: DataFrame, segments: DataFrame, videos: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """frames, their segments and videos (inner); ``only`` (segment_id) restricts to candidate segments."""
    if only is not None:
        frames = frames.join(only.select("segment_id").distinct(), "segment_id", "left_semi")
    return frames.join(segments, "segment_id").join(videos, "video_id")


def listed(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """A list of keys as a table (key, pos), each with the place it first has in the list."""
    schema = T.StructType([rows.schema[key], T.StructField("pos", T.IntegerType())])
    return rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(ids))], schema)


def ordered_frames(frames: DataFrame, segments: DataFrame, videos: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``frames_with_parents`` in the order of the video, the time and the frame; of given segments by time and frame alone."""
    by = ["ts", "frame_index"] if only is not None else ["video_id", "ts", "frame_index"]
    return frames_with_parents(frames, segments, videos, only).orderBy(*by)


#: The rank of a representative segment without one.
LAST_RANK = 999_999


def segments_of(segments: DataFrame, videos: DataFrame, ids: list, representative: bool = False) -> DataFrame:
    """The segments of the given videos with their video, in the order of the list, then of their start.

    Representative ones only on request, then in the order of their rank; those without a rank come last.
    """
    if representative:
        segments = segments.filter(F.coalesce("is_representative", F.lit(0)) == 1)
    by = F.coalesce("representative_rank", F.lit(LAST_RANK)) if representative else F.col("start_time")
    return segments.join(videos, "video_id").join(F.broadcast(listed(videos, "video_id", ids)), "video_id").orderBy("pos", by, "segment_id").drop("pos")


def lookup(hits: DataFrame, records: DataFrame, key: str, path: str = "path", keep_misses: bool = True) -> DataFrame:
    """Hits with their records; a miss is dropped or keeps its key as its path."""
    if not keep_misses:
        return hits.join(records, key)
    return hits.join(records, key, "left").withColumn(path, F.coalesce(path, F.col(key).cast("string")))


def candidates_or_all(scored: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Scored rows whose key is a candidate; all of them if there is none."""
    inside = scored.join(candidates.select(key).distinct(), key, "left_semi")
    some = inside.limit(1).agg((F.count("*") > 0).alias("__some"))
    return inside.unionByName(scored.crossJoin(F.broadcast(some)).filter("not __some").drop("__some"))


# ---- merges


@dataclass(frozen=True)
class MergeSpec:
    """What an upsert does to each column: overwrite it, keep the old value where the new one is null, or leave it alone."""

    keys: tuple[str, ...]
    overwrite: tuple[str, ...] = ()
    coalesce: tuple[str, ...] = ()
    insert: bool = True
    update: bool = True


# The rule of each table.
SPECS = {
    "video": MergeSpec(("video_id",), ("path", "duration", "status", "error_message", "updated_at"), ("embedding_path", "embedding_metadata_path", "embedding_norm")),
    "segment": MergeSpec(("segment_id",), ("video_id", "start_time", "end_time", "path"), ("embedding_path", "embedding_metadata_path", "embedding_norm")),
    "frame": MergeSpec(("frame_id",), ("segment_id", "timestamp", "frame_path", "embedding_path", "embedding_metadata_path", "frame_index", "width", "height", "embedding_norm")),
    "segment_embedding": MergeSpec(("segment_id",), ("embedding_path", "embedding_metadata_path", "embedding_norm"), ("importance_score", "motion_score", "visual_diversity_score"), insert=False),
    "video_caption": MergeSpec(("video_id",), ("caption_tags", "caption_description", "caption_payload"), ("path", "duration", "caption_model", "caption_updated_at")),
    "search_document": MergeSpec(("video_id",), ("tags_json", "description", "caption_text", "sparse_tags", "sparse_description", "sparse_caption"), ("path", "duration", "search_payload", "caption_model", "caption_updated_at", "embedding_model", "embedding_dim", "embedding_blob", "embedding_updated_at")),
    "image": MergeSpec(("image_id",), ("path", "width", "height", "embedding_path", "embedding_norm", "modality", "status", "error_message", "updated_at")),
    "image_caption": MergeSpec(("image_id",), ("path", "subject", "color", "action", "style", "description", "caption_text", "structured_json", "caption_model", "status", "error_message", "caption_updated_at")),
    "image_embedding": MergeSpec(("image_id",), ("embedding_model", "embedding_dim", "embedding_blob", "status", "embedding_updated_at"), insert=False),
    "task": MergeSpec(("task_id",), ("video_id", "stage", "status", "max_retry", "retry_count"), update=False),
}


def last_per_key(rows: DataFrame, keys: list[str], order: str, coalesce: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """The last (or first) row of each key; columns in ``coalesce`` take the last value that isn't null, as row-by-row upserts would."""
    pick = F.min_by if first else F.max_by
    others = [c for c in rows.columns if c not in keys]
    value = lambda c: pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) if c in coalesce else pick(F.col(c), F.col(order))
    return rows.groupBy(*keys).agg(*[value(c).alias(c) for c in others])


def merge(target: DataFrame, source: DataFrame, spec: MergeSpec, order: str | None = None) -> DataFrame:
    """The target after upserting the source by the spec; target columns that the source doesn't have stay."""
    if order:
        source = last_per_key(source, list(spec.keys), order, spec.coalesce, first=not spec.update).drop(order)
    given = [c for c in source.columns if c not in spec.keys]
    renamed = source.select(*spec.keys, *[F.col(c).alias(f"__n_{c}") for c in given], F.lit(True).alias("__new"))
    joined = target.withColumn("__old", F.lit(True)).join(renamed, list(spec.keys), "full_outer" if spec.insert else "left")
    out = []
    for c in target.columns:
        old, new = F.col(c), F.col(f"__n_{c}") if c in given else None
        if c in spec.keys or new is None:
            value = old
        elif c in spec.coalesce:
            value = F.coalesce(new, old)
        elif c in spec.overwrite:
            value = F.when(F.col("__new") & (F.col("__old").isNull() | F.lit(spec.update)), new).otherwise(old)
        else:
            value = F.when(F.col("__old").isNull(), new).otherwise(old)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)


def update(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A plain UPDATE: rows whose key has a change take all of its columns, nulls too; no row is added."""
    given = [c for c in changes.columns if c not in keys]
    return merge(target, changes, MergeSpec(tuple(keys), tuple(given), insert=False))


def mark_captioning(images: DataFrame, ids: DataFrame) -> DataFrame:
    """The images of ``ids`` (image_id) are being captioned; their last error goes."""
    return update(images, ids.select("image_id", F.lit("captioning").alias("status"), F.lit(None).cast("string").alias("error_message")), ["image_id"])


def mark_failed(images: DataFrame, failures: DataFrame, now: Column | None = None) -> DataFrame:
    """The images of ``failures`` (image_id, error) failed; captions and vectors they have stay."""
    when = [] if "updated_at" not in images.columns else [(F.current_timestamp() if now is None else now).cast(images.schema["updated_at"].dataType).alias("updated_at")]
    return update(images, failures.select("image_id", F.lit("failed").alias("status"), F.col("error").alias("error_message"), *when), ["image_id"])


def sync_records(target: DataFrame, records: DataFrame, spec: MergeSpec, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The target with the ok, tagged records merged in, and one row of counts (synced, skipped)."""
    good = (F.col("status") == "ok") & structured("description", "tags")
    counts = records.agg(F.count_if(good).alias("synced"), F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))
    wanted = set(target.columns) | set(spec.keys) | ({order} if order else set())
    return merge(target, records.filter(good).select(*[c for c in records.columns if c in wanted]), spec, order), counts


def delete_cascade(tables: dict[str, DataFrame], videos: DataFrame) -> dict[str, DataFrame]:
    """segments and frames without those of the given videos (video_id)."""
    gone = tables["segments"].join(videos.select("video_id"), "video_id", "left_semi").select("segment_id")
    return {"segments": tables["segments"].join(videos.select("video_id"), "video_id", "left_anti"), "frames": tables["frames"].join(gone, "segment_id", "left_anti")}


def flag_representatives(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Flags and ranks of the chosen segments' videos are cleared, then set: chosen has (video_id, segment_id, rank)."""
    videos = chosen.select("video_id").distinct().withColumn("__hit", F.lit(True))
    out = segments.join(chosen.select("segment_id", F.col("rank").alias("__rank")), "segment_id", "left").join(videos, "video_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return out.withColumns({"representative_rank": F.when(hit, F.col("__rank")).otherwise(F.col("representative_rank")), "is_representative": F.when(hit, F.col("__rank").isNotNull().cast("int")).otherwise(F.col("is_representative"))}).select(*segments.columns)


# ---- index maintenance


def sync_mode(new: DataFrame, indexed: DataFrame, key: str, exists: bool, force: bool, adds: int, limit: int = 50) -> DataFrame:
    """One row (mode, adds, n_append): whether an index needs nothing, new items appended, or a full build."""
    counts = new.select(key).distinct().join(indexed.select(key).distinct().withColumn("__in", F.lit(1)), key, "left").agg(F.count("*").alias("n_new"), F.count("__in").alias("n_known"))
    n, known = F.col("n_new"), F.col("n_known")
    mode = F.when((n == 0) & F.lit(exists) & ~F.lit(force), "noop").when(F.lit(force) | ~F.lit(exists) | F.lit(adds >= limit) | (known > 0), "full").otherwise("incremental")
    append = F.when(mode == "incremental", n).otherwise(0)
    return counts.select(mode.alias("mode"), F.when(mode == "full", 0).otherwise(F.lit(adds) + (append > 0).cast("int")).alias("adds"), append.cast("long").alias("n_append"))


# ---- tasks

# The stages of a video, in order, and what a reset of each takes with it.
STAGES = ("segment", "frame_extract", "embedding", "topk")
GLOBAL_STAGE, GLOBAL_VIDEO = "faiss", "__global__"
VIDEO_EVENTS = {"start": "processing", "complete": "done", "fail": "failed", "reset": "pending"}
DOWNSTREAM = {s: STAGES[i:] for i, s in enumerate(STAGES)} | {GLOBAL_STAGE: (GLOBAL_STAGE,)}
MAX_RETRY = 2


def ensure_tasks(tasks: DataFrame, videos: DataFrame) -> DataFrame:
    """The ledger with the four tasks of each video; known ones stay as they are."""
    fresh = videos.select("video_id", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    fresh = fresh.select(F.concat_ws(":", "video_id", "stage").alias("task_id"), "video_id", "stage", F.lit("pending").alias("status"), F.lit(MAX_RETRY).alias("max_retry"), F.lit(0).alias("retry_count"))
    return tasks.unionByName(fresh.join(tasks.select("task_id"), "task_id", "left_anti"), allowMissingColumns=True)


def update_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply one (task_id, new_status, error) each: failing counts a retry, anything else clears the error."""
    j = tasks.join(changes.withColumnRenamed("error", "__error"), "task_id", "left")
    hit, failed = F.col("new_status").isNotNull(), F.col("new_status") == "failed"
    cols = {
        "status": F.coalesce("new_status", "status"), "retry_count": F.coalesce("retry_count", F.lit(0)) + F.when(failed, 1).otherwise(0),
        "max_retry": F.coalesce("max_retry", F.lit(MAX_RETRY)), "error_message": F.when(hit, F.when(failed, F.col("__error"))).otherwise(F.col("error_message")),
    }
    return j.withColumns(cols).drop("new_status", "__error")


def task_action(status: str = "status", retries: str = "retry_count", most: str = "max_retry", force: bool = False) -> Column:
    """What starting a task does: skip a done one, raise for one out of retries, else run."""
    spent = (F.col(status) == "failed") & (F.col(retries) >= F.coalesce(most, F.lit(MAX_RETRY)))
    return F.when((F.col(status) == "done") & F.lit(not force), "skip").when(spent, "raise").otherwise("run")


def reset_tasks(tasks: DataFrame, video_ids: list, stage: str) -> DataFrame:
    """The stage and those after it back to pending, without error; retries stay counted."""
    chosen = listed(tasks, "video_id", video_ids).select("video_id", F.lit(True).alias("__hit"))
    out = tasks.join(chosen, "video_id", "left")
    hit = F.coalesce("__hit", F.lit(False)) & F.col("stage").isin(list(DOWNSTREAM[stage]))
    return out.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "error_message": F.when(~hit, F.col("error_message"))}).select(*tasks.columns)


def ensure_global_tasks(tasks: DataFrame) -> DataFrame:
    """The ledger with the task that all videos share."""
    spark = tasks.sparkSession
    fresh = spark.createDataFrame([(f"{GLOBAL_VIDEO}:{GLOBAL_STAGE}", GLOBAL_VIDEO, GLOBAL_STAGE, "pending", MAX_RETRY, 0)], "task_id string, video_id string, stage string, status string, max_retry int, retry_count int")
    return tasks.unionByName(fresh.join(tasks.select("task_id"), "task_id", "left_anti"), allowMissingColumns=True)


def ensure_videos(videos: DataFrame, tasks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos and tasks with those of ``found`` that aren't known yet, as pending; known ones stay as they are."""
    fresh = found.join(videos.select("video_id"), "video_id", "left_anti")
    if "status" in videos.columns and "status" not in found.columns:
        fresh = fresh.withColumn("status", F.lit("pending"))
    return videos.unionByName(fresh, allowMissingColumns=True), ensure_tasks(tasks, found)


def mark_videos(videos: DataFrame, changes: DataFrame) -> DataFrame:
    """Videos after (video_id, event, error): started ones are processing, completed done, failed failed with their message, reset pending."""
    status = F.create_map(*[F.lit(x) for kv in VIDEO_EVENTS.items() for x in kv])
    message = F.when(F.col("event") == "fail", F.col("error")).alias("error_message")
    return update(videos, changes.select("video_id", F.element_at(status, F.col("event")).alias("status"), message), ["video_id"])


def refresh_counts(results: DataFrame) -> DataFrame:
    """One row (videos, refreshed, success, failed) of the (video_id, status) of a run."""
    ok = F.col("status") == "ok"
    return results.agg(F.countDistinct("video_id").alias("videos"), F.countDistinct(F.when(ok, F.col("video_id"))).alias("refreshed"), F.count_if(ok).alias("success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def video_state(tasks: DataFrame) -> DataFrame:
    """The status of each video: failed if a task failed, done if all are, processing once one has begun, else pending."""
    return tasks.groupBy("video_id").agg(F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(F.count_if(F.col("status") != "done") == 0, "done").when(F.count_if(F.col("status") != "pending") > 0, "processing").otherwise("pending").alias("status"))


def outputs_ready(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, ready): whether all segments have a vector and frames, and all frames a vector."""
    by_segment = frames.groupBy("segment_id").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    j = segments.select("video_id", "segment_id", F.col("embedding").isNotNull().alias("has")).join(by_segment, "segment_id", "left")
    return j.groupBy("video_id").agg(F.every(F.col("has") & (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("missing", F.lit(0)) == 0)).alias("ready"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the least order value they occur at (key, pos): sorted by pos, the order of first sight."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return first.withColumnRenamed("__first", "pos")
