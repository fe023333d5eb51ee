"""Exact inner-product search and ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framequarry.functions.vector import dot

#: Query vectors multiplied at once; more of them are worked off in blocks.
QUERY_BLOCK = 1024


def inner_product_topk(index: DataFrame, queries: DataFrame, k: int, item: str = "item_id", vector: str = "embedding", query: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """The k items of largest inner product for each query: (query, item, score, rank), ties by item.

    The index is scanned once for each block of queries: a task multiplies its batches with the block and keeps k
    candidates a query, so that only partitions x queries x k rows are shuffled. Rows without a vector are left out.
    Scores are sums in the order of the vector, so that equal vectors have equal scores wherever they stand.
    Queries are a stated set of bounded size; they are read to the driver block by block.
    """
    spark = index.sparkSession
    rows = index.filter(F.col(vector).isNotNull()).select(F.col(item).alias("__item"), F.col(vector).cast("array<double>").alias("__v"))
    kind, query_kind = rows.schema["__item"].dataType, queries.schema[query].dataType
    schema = T.StructType([T.StructField(query, query_kind), T.StructField(item, kind), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = (to_arrow_type(query_kind), to_arrow_type(kind), pa.float64())
    out, part = None, []

    def search(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            ids: list = []
            scores, vectors = np.empty((len(names), 0)), np.empty((0, matrix.shape[1]))
            for batch in batches:
                items = batch.column(0).to_pylist()
                if not items:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
                scores, vectors, ids = np.hstack([scores, matrix @ flat.T]), np.vstack([vectors, flat]), [*ids, *items]
                if len(ids) > 8 * k + 4096:
                    keep = _kept(scores, matrix, vectors, ids, k)
                    scores, vectors, ids = scores[:, keep], vectors[keep], [ids[i] for i in keep]
            if ids:
                q, i, s = [], [], []
                for n, name in enumerate(names):
                    for j, score in _best(scores[n], matrix[n], vectors, ids, k):
                        q.append(name)
                        i.append(ids[j])
                        s.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((q, i, s), kinds, strict=True)], names=schema.names)

        return rows.mapInArrow(run, schema)

    for row in queries.filter(F.col(vector).isNotNull()).select(query, F.col(vector).cast("array<double>")).toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == block:
            found = search(part)
            out, part = found if out is None else out.union(found), []
    if part or out is None:
        found = search(part) if part else spark.createDataFrame([], schema)
        out = found if out is None else out.union(found)
    return ranked(out, [query], [F.desc("score"), F.asc(item)], k)


def _best(scores: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: list, k: int) -> list[tuple[int, float]]:
    """Positions and scores of the k largest, ties by id.

    ``scores`` are a matrix product's, whose last bits depend on where a vector stands: they choose what may be among
    the k, and the scores of those are summed anew in the order of the vector.
    """
    at = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        slack = 4 * len(query) * np.finfo(float).eps * np.linalg.norm(query) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
        at = np.nonzero(scores >= least - slack)[0]
    exact = np.cumsum(vectors[at] * query, axis=1)[:, -1].tolist()
    return sorted(zip(at.tolist(), exact, strict=True), key=lambda x: (-x[1], ids[x[0]]))[:k]


def _kept(scores: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: list, k: int) -> list[int]:
    return sorted({j for row, query in zip(scores, queries, strict=True) for j, _ in _best(row, query, vectors, ids, k)})


def inner_products(index: DataFrame, queries: DataFrame, vector: str = "embedding", query_vector: str = "query_vector") -> DataFrame:
    """Each index row with each query's inner product ``ip``; queries are a stated set small enough to broadcast."""
    return index.crossJoin(F.broadcast(queries)).withColumn("ip", dot(vector, query_vector))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """1-based ranks within the keys; with a limit only the first ones (pruned before the shuffle)."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if limit is None else out.filter(F.col(name) <= limit)


def rank_list(hits: DataFrame, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of one list with their 1-based ranks; a top-k, so that only these meet in one task."""
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def in_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the given keys, in the order of the list (column pos)."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(ids))], T.StructType([T.StructField("pos", T.IntegerType()), T.StructField(key, rows.schema[key].dataType)]))
    return rows.join(F.broadcast(wanted), key).orderBy("pos")
