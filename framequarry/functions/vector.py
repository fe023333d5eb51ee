"""Vector expressions over array columns; arithmetic is in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column | str, mode: str = "zero") -> Column:
    """Unit vectors. A vector too short to scale stays as it is (``zero``: of norm 0; ``tiny``: up to 1e-12) or is divided by 1e-12 (``clamp``)."""
    n = norm(v)
    if mode == "clamp":
        n = F.greatest(n, F.lit(1e-12))
    else:
        n = F.when(n > (0.0 if mode == "zero" else 1e-12), n).otherwise(1.0)
    # the norm is taken once a row, not once an element
    return F.aggregate(F.array(n), F.array().cast("array<double>"), lambda _, k: F.transform(_d(v), lambda x: x / k))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Groups whose sums a task holds before it sends them on.
HELD_GROUPS = 20_000


def vector_sum(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, mean: bool = False) -> DataFrame:
    """The (weighted) sum or mean vector of each group, by position: one row for each key; rows without a vector are left out.

    Each task adds up its own vectors first, so what is shuffled is a vector for each group and task, not one for each row.
    """
    given = df.filter(F.col(vector).isNotNull()).select(*keys, (F.lit(1.0) if weight is None else weight).cast("double").alias("__w"), _d(vector).alias("__v"))
    schema = T.StructType([*[given.schema[k] for k in keys], T.StructField("__w", T.DoubleType()), T.StructField("__v", T.ArrayType(T.DoubleType()))])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        code = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), np.int64)
        first = np.unique(code, return_index=True)[1]
        size = max(map(len, rows["__v"]))
        values = np.array([np.pad(v, (0, size - len(v))) if len(v) < size else v for v in rows["__v"]], float)
        sums = np.zeros((len(first), size))
        np.add.at(sums, code, values)
        out = rows.iloc[first][keys].copy()
        out["__w"] = np.bincount(code, rows["__w"].to_numpy(float), len(first))
        out["__v"] = list(sums)
        return out

    def run(batches):
        held = None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows.copy()
            rows["__v"] = [np.asarray(v, float) * w for v, w in zip(rows["__v"], rows["__w"], strict=True)]
            held = add(rows if held is None else pd.concat([held, add(rows)], ignore_index=True))
            if len(held) > HELD_GROUPS:
                yield held
                held = None
        if held is not None:
            yield held

    parts = given.mapInPandas(run, schema).groupBy(*keys).agg(F.sum("__w").alias("__w"), F.collect_list("__v").alias("__l"))
    total = F.aggregate("__l", F.slice(F.element_at("__l", 1), 1, 0), lambda s, v: F.zip_with(s, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    by = F.col("__w") if mean else F.lit(1.0)
    return parts.select(*keys, F.transform(total, lambda x: x / by).alias(vector))
