"""File scans, JSON lines, vector tables and their sinks."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.functions.captions import normalize_records
from framequarry.functions.paths import image_source
from framequarry.operators.tables import last_per_key, structured

# The endings of media files.
VIDEO_ENDINGS = ("mp4", "mov", "avi", "mkv", "webm", "flv", "m4v")
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "bmp", "gif")
CAPTION_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    *[(n, T.StringType()) for n in ("video_id", "videoID", "video_path", "videoPath", "path", "status", "caption", "caption_text", "description", "caption_description", "captionTags", "duration_seconds", "duration", "model", "caption_model", "created_at", "error")],
    ("tags", T.StringType()), ("caption_tags", T.StringType()), ("structured_caption", T.StringType()),
)])


def media_files(spark: SparkSession, folder: str, endings: tuple[str, ...], content: bool = False) -> DataFrame:
    """Files below a folder by ending, sorted by path; without ``content`` their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.filter(F.lower("path").rlike(rf"\.(?:{'|'.join(endings)})$"))
    return kept.select("path", "length", "modificationTime", *(["content"] if content else [])).orderBy("path")


def videos(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    return media_files(spark, folder, VIDEO_ENDINGS, content)


def images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    return media_files(spark, folder, IMAGE_ENDINGS, content)


def frames_in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Frame files with frame_index, from names that end in _f and digits."""
    found = images(spark, folder).withColumn("frame_index", F.regexp_extract("path", r"_f(\d+)\.[^./]+$", 1).try_cast("int"))
    return found.filter("frame_index is not null")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that aren't objects go; a bad line raises, or goes too if tolerant."""
    is_object = F.col("value").rlike(r"^\s*\{")
    objects = numbered_lines(spark, path).filter(is_object)
    if tolerant:
        objects = objects.filter(F.try_parse_json("value").isNotNull())
    # guarded: filters that come later may be evaluated before the one above
    parsed = F.from_json(F.when(is_object, F.col("value")), schema, {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})
    return objects.select("line_no", parsed.alias("r")).select("line_no", "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with an increasing line_no (unique over files, in order within each)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value").filter(F.trim("value") != "")


def prompt_text(spark: SparkSession, path: str) -> DataFrame:
    """One row: the non-blank lines of a (small) prompt file joined by blanks."""
    rows = numbered_lines(spark, path).groupBy().agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("value").alias("v")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["v"]), " ").alias("prompt"))


def caption_records(spark: SparkSession, path: str, include_failed: bool = False, structured_only: bool = False) -> DataFrame:
    """Normalised records with an id and a description; failed ones and unstructured ones on request."""
    found = normalize_records(read_jsonl(spark, path, CAPTION_SCHEMA)).filter("video_id is not null")
    if not include_failed:
        found = found.filter("status = 'ok'")
    found = found.filter(F.trim("description") != "")
    return found.filter(structured("description", "tags")) if structured_only else found


def resume_records(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """Of a caption log with possibly broken lines the last record of each video."""
    rows = read_jsonl(spark, path, CAPTION_SCHEMA, tolerant=True)
    rows = rows.withColumn(key, F.coalesce(F.col(key), F.col("videoID")) if key == "video_id" else F.col(key)).filter(F.col(key).isNotNull())
    return last_per_key(rows, [key], "line_no")


def read_vectors(spark: SparkSession, path: str, expected_kind: str | None = None) -> DataFrame:
    """A vector table; raises if its index_kind is known and another one is expected."""
    found = spark.read.parquet(path)
    if expected_kind and "index_kind" in found.columns:
        kinds = [r[0] for r in found.select("index_kind").filter("index_kind is not null").distinct().limit(2).collect()]
        if kinds and kinds != [expected_kind]:
            raise ValueError(f"index kind is {kinds}, expected {expected_kind}")
    return found


def write_vectors(rows: DataFrame, path: str, kind: str | None = None, model: str | None = None) -> None:
    """Persist an index (empty ones too) with its kind and model as columns."""
    rows.withColumns({"index_kind": F.lit(kind).cast("string"), "model_name": F.lit(model).cast("string")}).write.mode("overwrite").parquet(path)


def npy_vectors(spark: SparkSession, folder: str, normalize: bool = False) -> DataFrame:
    """(path, name, embedding) of the .npy files below a folder, each one vector; unreadable files have none."""
    rows = media_files(spark, folder, ("npy",), content=True)

    @F.pandas_udf("array<float>")
    def load(blobs: pd.Series) -> pd.Series:
        def one(blob: bytes):
            try:
                v = np.load(io.BytesIO(blob), allow_pickle=False).astype(np.float32).ravel()
            except (ValueError, OSError, EOFError):
                return None
            n = float(np.linalg.norm(v))
            return v / n if normalize and n > 0 else v

        return blobs.map(one)

    return rows.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("name"), load("content").alias("embedding"))


def index_items(spark: SparkSession, path: str, expected_kind: str | None = None) -> DataFrame:
    """(pos, item_id) of an index's JSON sidecar {dim, item_ids}, or the older frame_ids; raises on another index kind."""
    kept = read_object(spark, path)
    kind = kept.get("index_kind")
    if expected_kind and kind and kind != expected_kind:
        raise ValueError(f"index kind is {kind}, expected {expected_kind}")
    ids = kept.get("item_ids") or kept.get("frame_ids") or []
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "pos int, item_id string")


def read_object(spark: SparkSession, path: str) -> dict:
    """A (small) JSON object from any store Spark reads; {} if it isn't there or isn't an object."""
    try:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        found = json.loads(text)
    except (AnalysisException, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_object(spark: SparkSession, value: dict | list, path: str) -> None:
    """One JSON file, indented by 2, in UTF-8, in any store Spark writes; an old one is replaced once the new one is whole."""
    fs, target = _file_system(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    out.close()
    fs.delete(target, True)
    fs.rename(fresh, target)


def rewrite_jsonl(rows: DataFrame, path: str) -> None:
    """Replace a JSON-lines folder, which ``rows`` may be read from: written beside it, then swapped."""
    spark = rows.sparkSession
    fresh = f"{path}.tmp-{uuid.uuid4().hex}"
    rows.write.json(fresh)
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), target)


def error_rows(failures: DataFrame, stage: str, key: str = "video_id", now: Column | None = None) -> DataFrame:
    """Rows of the error log from (key, error): (created_at, stage, item_id, error), to be appended as JSON lines."""
    when = F.current_timestamp() if now is None else now
    return failures.select(F.date_format(when.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"), F.lit(stage).alias("stage"), F.col(key).cast("string").alias("item_id"), "error")


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: T.StructType, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors see, read by ranges of its rowid; columns that it lacks are null."""
    if not table.isidentifier():
        raise ValueError(f"not a table's name: {table}")
    link = f"file:{path.removeprefix('file://')}?mode=ro"
    with contextlib.closing(sqlite3.connect(link, uri=True)) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
        have = {r[1] for r in db.execute(f"PRAGMA table_info({table})")}
    names = ", ".join(f.name if f.name in have else f"NULL AS {f.name}" for f in schema.fields)
    step = -(-((high or 0) - (low or 0) + 1) // partitions)

    def read(batches):
        for own in batches:
            for first in own["first"].tolist():
                with contextlib.closing(sqlite3.connect(link, uri=True)) as db:
                    cursor = db.execute(f"SELECT {names} FROM {table} WHERE rowid >= ? AND rowid < ?", (first, first + step))
                    while rows := cursor.fetchmany(1000):
                        yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    starts = spark.createDataFrame([] if low is None else [(low + i * step,) for i in range(partitions)], "first long")
    return starts.repartition(partitions).mapInPandas(read, schema)


def probe(files: DataFrame, decode: Callable[[bytes], tuple[int, float]]) -> DataFrame:
    """Video files (path, content) with frames, fps and duration by a decoder that returns frames and rate; 0.0 where it fails."""
    schema = T.StructType([files.schema["path"], T.StructField("frames", T.LongType()), T.StructField("fps", T.DoubleType()), T.StructField("duration", T.DoubleType())])

    def one(blob: bytes) -> tuple:
        try:
            frames, fps = decode(blob)
        except Exception:  # the decoder is the user's; a file it can't read has no length
            return 0, 0.0, 0.0
        return int(frames), float(fps), float(frames) / float(fps) if fps > 0 else 0.0

    def run(batches):
        for own in batches:
            made = [one(b) for b in own["content"]]
            yield pd.DataFrame({"path": own["path"], **{n: [m[i] for m in made] for i, n in enumerate(("frames", "fps", "duration"))}})

    return files.select("path", "content").mapInPandas(run, schema)


def validated(files: DataFrame, decode: Callable[[bytes], tuple[int, int]]) -> DataFrame:
    """Image files (path, content) with ok, error, width and height by a decoder that returns the size."""
    schema = T.StructType([files.schema["path"], *[T.StructField(n, t) for n, t in (("ok", T.BooleanType()), ("error", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()))]])

    def one(blob: bytes) -> tuple:
        try:
            width, height = decode(blob)
        except Exception as e:  # the decoder is the user's: whatever it raises is the file's error
            return False, f"{type(e).__name__}: {e}", 0, 0
        return True, None, int(width), int(height)

    def run(batches):
        for own in batches:
            made = [one(b) for b in own["content"]]
            yield pd.DataFrame({"path": own["path"], **{n: [m[i] for m in made] for i, n in enumerate(("ok", "error", "width", "height"))}})

    return files.select("path", "content").mapInPandas(run, schema)


def image_bytes(sources: DataFrame, files: DataFrame, source: str = "source") -> DataFrame:
    """Rows with kind and bytes of a source: decoded base64, or the content of the file (path, content) it names; a URL has none."""
    told = sources.withColumn("__s", image_source(source))
    named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("__path"), F.col("content").alias("__content"))
    own = F.when(F.col("__s.kind") == "path", F.regexp_replace(F.trim(source), "^file:/*", "/"))
    out = told.withColumn("__path", own).join(named, "__path", "left")
    return out.withColumns({"kind": F.col("__s.kind"), "bytes": F.coalesce("__s.bytes", "__content")}).drop("__s", "__path", "__content")


def decode_floats(blob: Column | str, dim: Column | str) -> Column:
    """A little-endian float32 blob as array<float>; null where its size isn't that of ``dim`` numbers."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f4") if b is not None and d == d and d is not None and len(b) == 4 * int(d) else None for b, d in zip(blobs, dims, strict=True)])

    return decode(blob, F.col(dim).cast("double") if isinstance(dim, str) else dim.cast("double"))


def encode_floats(vector: Column | str) -> Column:
    """array<float> as a little-endian float32 blob."""
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def keyed_json(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, json): each row as a JSON object under its key."""
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def keyed_object(rows: DataFrame, key: str) -> DataFrame:
    """One row (json): a single object of all rows under their keys, for the (bounded) result of a batch."""
    own = keyed_json(rows, key)
    return own.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.col("key").cast("string").cast("variant")), F.lit(":"), "json"))), ","), F.lit("}")).alias("json"))


def manifest(index: DataFrame, encoded: DataFrame, mode: str, adds: int) -> DataFrame:
    """One row about a build: records indexed, encoded, reused, the mode and the count of incremental additions."""
    a, b = index.agg(F.count("*").alias("records_indexed")), encoded.agg(F.count("*").alias("records_encoded"))
    return a.crossJoin(b).select("records_indexed", "records_encoded", (F.col("records_indexed") - F.col("records_encoded")).alias("records_reused"), F.lit(mode).alias("last_build_mode"), F.lit(adds).alias("incremental_adds"))
