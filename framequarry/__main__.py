"""python -m framequarry queries | run NAME DIR | index DIR OUT | search DIR TEXT | captions LOG TABLE | rebuild ROOT PROFILE | reset ROOT PROFILE STAGE ID... | check ROOT PROFILE"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry import queries
from framequarry.catalog import Profile, exists
from framequarry.functions.captions import normalize_records
from framequarry.operators import bm25, tables
from framequarry.plans import engines
from framequarry.plans.encoders import HashEncoder
from framequarry.session import build, clear, materialise
from framequarry.sources import files
from framequarry.streaming.ingest import RECORD_SPEC


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framequarry", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="list the registered queries")
    run = sub.add_parser("run", help="run a query and show its rows")
    run.add_argument("name", choices=sorted(queries.QUERIES))
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    index = sub.add_parser("index", help="write term fields and vectors of a documents table")
    index.add_argument("folder")
    index.add_argument("out")
    search = sub.add_parser("search", help="hybrid search over a documents table")
    search.add_argument("folder")
    search.add_argument("text")
    search.add_argument("--top-k", type=int, default=10)
    captions = sub.add_parser("captions", help="merge the ok, tagged records of a caption log into a table")
    captions.add_argument("log")
    captions.add_argument("table")
    for name, text in (("rebuild", "build segments and the three vector indexes of a profile anew"), ("reset", "set a stage of some videos, and what follows it, back to pending"), ("check", "list what a profile lacks")):
        one = sub.add_parser(name, help=text)
        one.add_argument("root")
        one.add_argument("profile")
        if name == "reset":
            one.add_argument("stage", choices=sorted(tables.DOWNSTREAM))
            one.add_argument("ids", nargs="+")
    given = parser.parse_args(argv)
    if given.command == "queries":
        print(*sorted(queries.QUERIES), sep="\n")
        return
    spark = build()
    if given.command == "run":
        queries.QUERIES[given.name](spark, given.folder).show(given.rows, truncate=False)
    elif given.command == "index":
        docs = queries.search_docs(spark, given.folder, embed=True)
        bm25.term_fields(docs, "video_id", F.col("tags"), F.col("description"), F.col("caption")).write.mode("overwrite").parquet(f"{given.out}/search_documents")
        docs.select(F.col("video_id").alias("item_id"), "embedding").write.mode("overwrite").parquet(f"{given.out}/vectors_video")
    elif given.command == "captions":
        records = files.resume_records(spark, given.log).transform(normalize_records)
        known = exists(spark, given.table)
        target = spark.read.parquet(given.table) if known else records.limit(0)
        out, counts = tables.sync_records(target, records, RECORD_SPEC)
        replace(materialise(out, "captions"), given.table)
        counts.show()
    elif given.command in ("rebuild", "reset", "check"):
        profile = Profile(given.profile, given.root)
        if given.command == "check":
            print(*(profile.check(spark) or ["nothing is missing"]), sep="\n")
        elif given.command == "reset":
            path = profile.path(spark, "tasks")
            replace(materialise(tables.reset_tasks(spark.read.parquet(path), given.ids, given.stage), "tasks"), path)
        else:
            frames = spark.read.parquet(profile.path(spark, "frames"))
            segments = materialise(engines.build_segments(frames), "segments")
            replace(segments, profile.path(spark, "segments"))
            for name, index in engines.index_tables(frames, segments).items():
                files.write_vectors(index, profile.path(spark, name), kind=name.partition("_")[2])
    else:
        engine = engines.HybridEngine(queries.search_docs(spark, given.folder, embed=True), HashEncoder())
        engine.search(given.text, given.top_k).show(given.top_k, truncate=80)
    clear(spark)


def replace(rows: DataFrame, path: str) -> None:
    """Write rows, which must not be read from there, over a table."""
    rows.write.mode("overwrite").parquet(path)


if __name__ == "__main__":
    main()
