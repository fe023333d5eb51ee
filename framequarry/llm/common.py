"""What the operators of this package share: Arrow batches, hashed samples, class priors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framequarry.functions.batches import release

#: Rows in an Arrow batch; a batch of the longest texts must fit a Python worker.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add: its own win over clashing ones of the input."""
    lost = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lost])


def map_texts(df: DataFrame, make: Callable[[], Callable[..., Sequence]], inputs: Sequence[str], keep: Sequence[str], fields: Sequence[T.StructField]) -> DataFrame:
    """Add ``fields`` to the columns ``keep``, computed from ``inputs`` over Arrow batches.

    ``make`` runs once a task and returns a function of the input columns (``pa.Array`` each), which returns one
    list or array for each field, as long as the batch.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    columns = list(dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names, kept, given = [f.name for f in schema], list(keep), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(*(batch.column(c) for c in given))
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=k, from_pandas=False) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=names)
        work = batch = made = None
        release()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def bucket(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def hashed_sample(df: DataFrame, key: str, fraction: Column | float) -> DataFrame:
    """The rows whose hashed key falls into ``fraction`` of the hash range: the same rows at every run."""
    fraction = F.lit(float(fraction)) if isinstance(fraction, (int, float)) else fraction
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < fraction * float(1 << 30))


def distinct_sample(df: DataFrame, value: str, n: int) -> list[Row]:
    """At most ``n`` distinct values of a column, spread by their hash: the same at every run, however often a value is repeated."""
    rows = df.select(value)
    total = rows.count()
    picked = hashed_sample(rows, value, min(1.0, 1.5 * n / total)) if total > n else rows
    return picked.distinct().orderBy(F.xxhash64(value), value).limit(n).collect() if total else []


def spread_sample(df: DataFrame, value: str, n: int) -> list[Row]:
    """About ``n`` rows of a column, repeated values as often as they occur: of each value a share fixed by its hash.

    A value of many rows is thinned, so that the number stays near n; the same at every run.
    """
    rows = df.select(value, F.xxhash64(value).alias("__h"))
    counted = rows.groupBy("__h").agg(F.count("*").alias("__n"))
    total = df.count()
    if not total:
        return []
    each = F.col("__n") * F.lit(min(1.0, n / total))
    part = F.pmod("__h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(each) + (part < each - F.floor(each)).cast("long")).alias("__times")
    chosen = counted.select("__h", times).filter("__times > 0").orderBy("__h").limit(2 * n)
    found = rows.join(F.broadcast(chosen), "__h").dropDuplicates(["__h"]).orderBy("__h").collect()
    return [r for r in found for _ in range(r["__times"])]


def rows_of(df: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of ``df`` whose key is among a hashed sample of about ``n`` of the distinct ``keys``, which is broadcast.

    So the rows themselves aren't shuffled, however many they are.
    """
    total = keys.count()
    chosen = hashed_sample(keys, key, min(1.0, n / max(1, total)))
    return df.join(F.broadcast(chosen), key)
