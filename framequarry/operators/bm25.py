"""Full-text ranking: an inverted index as DataFrames, BM25 with field weights."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.functions import text as X
from framequarry.functions.batches import lots
from framequarry.session import materialise, spread

#: Effective field weights.
WEIGHTS = {"tags": 2.0, "description": 1.0, "caption": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Gains are added up in units of 1 / UNIT, and what is less in units of 1 / (UNIT * REST).
UNIT, REST = 1 << 20, 1 << 40
#: Rows (query, term) that are broadcast at most.
BROADCAST_ROWS = 200_000


@dataclass
class SparseIndex:
    """postings (key, term, f: weighted frequency, length of the document over all fields) and stats (n_docs, avg_length)."""

    key: str
    postings: DataFrame
    stats: DataFrame


def term_fields(docs: DataFrame, key: str, tags: Column, description: Column, caption: Column) -> DataFrame:
    """(key, tags_terms, description_terms, caption_terms): the space-joined text of each sparse field, as a table keeps it."""
    names = ["tags_terms", "description_terms", "caption_terms"]
    schema = T.StructType([docs.select(key).schema[0], *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches):
        for batch in lots(batches):
            rows = [[" ".join(x) for x in X.field_terms(*row)] for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=schema.names)

    return spread(docs.select(key, tags, description, caption)).mapInArrow(run, schema)


def build(fields: DataFrame, key: str, weights: dict[str, float] = WEIGHTS) -> SparseIndex:
    """An index over space-joined fields (``term_fields``); they are split again at anything that isn't a letter or a digit.

    A document's postings are made in one pass, without a shuffle, and of a few documents at a time. Postings and statistics are written to the shared
    folder once; searches read them and not the texts.
    """
    schema = T.StructType([fields.schema[key], T.StructField("term", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("length", T.LongType()), T.StructField("once", T.LongType())])
    split = re.compile(r"[^\W_]+").findall

    def run(batches):
        for batch in lots(batches):
            at, terms, f, lengths, once = [], [], [], [], []
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 1 + len(weights))), strict=True)):
                counts: dict[str, float] = {}
                n = 0
                for text, w in zip(row, weights.values(), strict=True):
                    for t in split((text or "").lower()):
                        counts[t] = counts.get(t, 0.0) + w
                        n += 1
                counts = counts or {None: 0.0}  # a document without a term still counts as one
                at += [i] * len(counts)
                terms += counts
                f += counts.values()
                lengths += [n] * len(counts)
                once += [n, *[None] * (len(counts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(f, pa.float64()), pa.array(lengths, pa.int64()), pa.array(once, pa.int64())], names=schema.names)

    rows = materialise(fields.select(key, *[f"{n}_terms" for n in weights]).mapInArrow(run, schema), "postings")
    stats = rows.agg(F.count("once").alias("n_docs"), F.avg("once").alias("avg_length"))
    return SparseIndex(key, rows.filter("term is not null").drop("once"), materialise(stats, "postings-stats"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def search(index: SparseIndex, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """Scores of (query, term) rows against the index: (query, key, sparse_score); the lower the better.

    Postings are filtered by the queries' terms before anything is computed. A document's gains are added up in whole
    numbers, so that the sum doesn't depend on their order: documents of equal gains have equal scores.
    """
    terms = bounded(queries.select(query, "term").distinct())
    hit = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    s = hit.join(df, "term").crossJoin(F.broadcast(index.stats))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    gain = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = s.select(index.key, "term", (gain * float(UNIT)).alias("gain"))
    whole = F.floor("gain")
    rest = F.floor((F.col("gain") - whole) * float(REST))
    return scored.join(terms, "term").groupBy(query, index.key).agg((-(F.sum(whole) + F.sum(rest) / float(REST)) / float(UNIT)).alias("sparse_score"))


def query_rows(queries: DataFrame, text: str, query: str = "query_id") -> DataFrame:
    """(query, term) rows of query texts."""
    return queries.select(query, F.explode(X.query_terms(text)).alias("term"))
