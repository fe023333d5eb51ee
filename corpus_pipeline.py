"""A training corpus in five stages: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; the last returns the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
SQL can't express the learned and greedy stages, so ORACLE_SQL is None and tests/llm compares with a plain version.

Defined cases, of every stage: null and empty texts are kept unless the stage's decision is about them (they score as harmless,
are near-duplicates of each other, hold no benchmark and no personal data, and are one piece each); very long texts are
read whole; rows of equal doc_id are treated one by one, repeated rows are near-duplicates; null doc_ids are documents like any
other; an empty table gives an empty one; other columns pass through, whatever their names, but for names of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import decontaminate, jaccard, packing, pii, toxicity
from framequarry.llm.common import read_table
from framequarry.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; learned from the labels of these documents."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    own = docs.withColumnRenamed("toxicity_score", "__toxicity_score")  # a column of this name of the input passes through
    kept = toxicity.score(own, model).filter(F.col("toxicity_score") < toxicity.THRESHOLD).drop("toxicity_score")
    return kept.withColumnRenamed("__toxicity_score", "toxicity_score").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more."""
    return jaccard.keep_representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
