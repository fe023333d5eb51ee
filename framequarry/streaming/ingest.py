"""Continuous ingest of caption records and sessions over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framequarry.functions.captions import normalize_records
from framequarry.operators.tables import MergeSpec, merge
from framequarry.session import shared_dir
from framequarry.sources.files import CAPTION_SCHEMA

RECORD_SPEC = MergeSpec(("video_id",), ("status", "tags", "description", "caption"), ("video_path", "duration_seconds", "model", "created_at"))


def caption_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Caption records as their files arrive; lines that don't parse come out without an id and go."""
    rows = spark.readStream.schema(CAPTION_SCHEMA).option("mode", "PERMISSIVE").json(folder)
    return normalize_records(rows).filter("video_id is not null")


#: Parts of a table by a hash of the key; a batch rewrites those it has keys of.
BUCKETS = 64


def ingest_captions(stream: DataFrame, table: str, checkpoint: str | None = None, name: str = "captions", buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch into the Parquet table at ``table`` and end when all that is there has been read.

    A batch writes the buckets it touches as a new version beside the old one, so what it costs follows its own size, and a
    batch that is run again after a failure starts from what was there before it. Versions that newer ones have replaced
    are deleted. Columns that a batch leaves null keep their old value.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_dir(spark)}/framequarry/stream-{name}"

    def upsert(batch: DataFrame, number: int) -> None:
        source = batch.withColumns({"__order": F.monotonically_increasing_id(), "bucket": F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")})
        touched = {r.bucket for r in source.select("bucket").distinct().collect()}
        old = current(spark, table, number, touched)
        empty = source.drop("__order").limit(0)
        out = merge(empty if old is None else empty.unionByName(old, allowMissingColumns=True), source, RECORD_SPEC, order="__order")
        bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")
        out.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={number}")
        retire(spark, table, number)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()


def _versions(spark: SparkSession, table: str):
    """The file system, and the whole versions with their buckets, newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p, head: [int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(p) if x.getPath().getName().startswith(head)]
    found = names(root, "version=") if fs.exists(root) else []
    whole = [n for n in sorted(found, reverse=True) if fs.exists(path(f"{table}/version={n}/_SUCCESS"))]
    return fs, {n: set(names(path(f"{table}/version={n}"), "bucket=")) for n in whole}


def current(spark: SparkSession, table: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest whole version of each bucket (of those given), from versions older than ``before`` if given."""
    _, versions = _versions(spark, table)
    seen: dict[int, int] = {}
    for n, own in versions.items():
        if before is None or n < before:
            for b in own:
                seen.setdefault(b, n)
    paths = [f"{table}/version={n}/bucket={b}" for b, n in sorted(seen.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def retire(spark: SparkSession, table: str, number: int) -> None:
    """Delete what versions before ``number`` have replaced: a batch that is run again reads no further back."""
    fs, versions = _versions(spark, table)
    seen: set[int] = set()
    for n, own in versions.items():
        if n < number:
            for b in own & seen:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={n}/bucket={b}"), True)
            seen |= own


def sessions(events: DataFrame, key: str, ts: str, value: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Gap sessions of each key (batch or stream): (key, start, stop, n, peak); the stream's late data are cut at the watermark."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", lateness)
    grouped = rows.groupBy(key, F.session_window("__ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max(value).alias("peak")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "peak")
