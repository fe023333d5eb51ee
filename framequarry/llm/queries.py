"""The queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm.common import bucket, read_table


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import lzprint

    return lzprint.edits(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import pii
    from framequarry.session import materialise

    found = materialise(pii.candidates(read_table(spark, sf_dir, "documents"), ["doc_id"]), "candidates")
    spans = pii.accepted(pii.fit(found))
    counts = [pii.count(k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import decontaminate

    found = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), bucket("doc_id", 4) != 2)
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, bucket("doc_id", 4) != 2), keep=["doc_id"])
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import suffixdedup

    return suffixdedup.digests(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import simhash

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import licenses

    docs = read_table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs), keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licensed"), F.array_join(names, ",").alias("families"), spans.alias("paragraphs"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["probability"])), F.lit(0.0)).alias("score"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from framequarry.llm import packing

    found = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequarry.llm import quality
    from framequarry.session import materialise

    stats = materialise(quality.with_statistics(read_table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    model = quality.fit(stats, read_table(spark, sf_dir, "labels"), bucket("doc_id", 3) != 1)
    found = quality.score(stats, model, keep=["doc_id"])
    return found.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_lz_fingerprint, op2_pii, op3_decontaminate, op4_toxicity, op5_language_id, op6_suffix_dedup, op7_simhash, op8_licenses, op9_packing, op10_quality)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# The other queries hold learned scores, hashes or tokens that DuckDB has no function for, or compare all strings; they are
# tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)), sizes AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
 hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
