"""Score pooling: averages, smooth maxima and consensus over each group's largest scores; vector pooling; genericness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.config import RetrievalConfig
from framequarry.functions.vector import clamp, dot, l2_normalize, norm, vector_sum


def _top(rows: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__s")))
    return rows.select(*keys, F.col(score).cast("double").alias("__s")).withColumn("__r", rank).filter(F.col("__r") <= max(1, k))


def average_top_k(rows: DataFrame, keys: list[str], score: str, k: int, name: str = "average") -> DataFrame:
    return _top(rows, keys, score, k).groupBy(*keys).agg(F.avg("__s").alias(name))


def _smooth(values: Column, beta: float) -> Column:
    top = F.array_max(values)
    soft = top + (F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp((x - top) * beta))) - F.log(F.size(values).cast("double"))) / beta if beta > 0 else top
    return F.when(F.size(values) <= 1, F.coalesce(top, F.lit(0.0))).otherwise(soft)


def smoothmax_top_k(rows: DataFrame, keys: list[str], score: str, k: int, beta: float, name: str = "smoothmax") -> DataFrame:
    """Of each group's k largest scores (at most k values are gathered): their smooth maximum."""
    return _top(rows, keys, score, k).groupBy(*keys).agg(F.collect_list("__s").alias("__v")).select(*keys, _smooth(F.col("__v"), beta).alias(name))


def consensus_top_k(rows: DataFrame, keys: list[str], score: str, k: int, config: RetrievalConfig = RetrievalConfig(), name: str = "consensus") -> DataFrame:
    """Smooth maximum and average of the k largest scores, a bonus for support and a penalty for a lone spike."""
    top = _top(rows, keys, score, k).groupBy(*keys).agg(F.collect_list("__s").alias("__v"), F.avg("__s").alias("__a"), F.max("__s").alias("__max"), F.min("__s").alias("__min"), F.avg((F.col("__s") >= config.support_floor).cast("double")).alias("__ratio"))
    core = 0.65 * _smooth(F.col("__v"), config.rerank_beta) + 0.35 * F.col("__a")
    bonus = config.support_bonus * F.col("__ratio") * F.col("__min")
    penalty = config.spike_penalty * F.greatest(F.lit(0.0), F.col("__max") - F.col("__a")) * (1 - F.col("__ratio"))
    return top.select(*keys, F.when(F.size("__v") == 1, F.col("__max")).otherwise(core + bonus - penalty).alias(name))


def attention_pool(rows: DataFrame, keys: list[str], vector: str, score: str) -> DataFrame:
    """Softmax-weighted vector of each group, of unit length."""
    top = Window.partitionBy(*keys)
    weighed = rows.withColumn("__w", F.exp(F.col(score).cast("double") - F.max(F.col(score).cast("double")).over(top)))
    return vector_sum(weighed, keys, vector, F.col("__w"), mean=True).withColumn(vector, l2_normalize(vector))


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return vector_sum(rows, keys, vector, mean=True).withColumn(vector, l2_normalize(vector, "clamp"))


def genericness(rows: DataFrame, item: str, vector: str, name: str = "genericness") -> DataFrame:
    """The mean similarity of each row to all others, over all N rows, without pairs: (v.S - v.v) / N with S the sum of unit vectors."""
    unit = rows.select(item, l2_normalize(vector, "clamp").alias("__v"))
    total = vector_sum(unit.select(F.lit(0).alias("__all"), "__v"), ["__all"], "__v").select(F.col("__v").alias("__sum"))
    n = unit.agg(F.count("*").alias("__n"))
    return unit.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).select(item, ((dot("__v", "__sum") - dot("__v", "__v")) / F.col("__n")).alias(name))


def diversity(rows: DataFrame, keys: list[str], vector: str, name: str = "diversity") -> DataFrame:
    """One less the mean pairwise similarity of each group, from the norm of its sum vector; 0 for a single row."""
    unit = rows.select(*keys, l2_normalize(vector, "clamp").alias("__v"))
    n = unit.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = vector_sum(unit, keys, "__v").join(n, keys)
    k = F.col("__n")
    return total.select(*keys, F.when(k > 1, 1 - (F.pow(norm("__v"), 2) - k) / (k * (k - 1))).otherwise(0.0).alias(name))


def adjacent_motion(rows: DataFrame, keys: list[str], order: list[str], values: str, name: str = "motion") -> DataFrame:
    """Mean absolute difference of consecutive signatures (arrays of grey values), 0 for a single one."""
    before = F.lag(values).over(Window.partitionBy(*keys).orderBy(*order))
    step = F.aggregate(F.zip_with(F.col(values).cast("array<double>"), F.col("__b").cast("array<double>"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return rows.withColumn("__b", before).groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("__b").isNotNull(), step)), F.lit(0.0)).alias(name))


def temporal_coverage(rows: DataFrame, keys: list[str], ts: str, duration: str | None = None, name: str = "coverage") -> DataFrame:
    """Share of a segment's duration that its frames span; of no duration all of it; 0 for a single frame."""
    length = F.max(duration) if duration else F.lit(None).cast("double")
    span = F.max(ts) - F.min(ts)
    whole = F.when(length > 0, length).otherwise(span)
    return rows.groupBy(*keys).agg(F.when(F.count("*") <= 1, 0.0).otherwise(clamp(span / F.greatest(whole, F.lit(1e-6)), 0.0, 1.0)).alias(name))


def segment_importance(frames: DataFrame, keys: list[str], vector: str, raw_norm: str, ts: str, duration: str, frame_motion: DataFrame | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, norm_score, motion_score, diversity, importance): motion is 0.8 frame difference and 0.2 coverage."""
    norms = frames.groupBy(*keys).agg(F.avg(raw_norm).alias("norm_score"))
    out = norms.join(temporal_coverage(frames, keys, ts, duration), keys).join(diversity(frames, keys, vector), keys)
    out = out.join(frame_motion, keys, "left") if frame_motion is not None else out.withColumn("motion", F.lit(0.0))
    motion = 0.8 * F.coalesce("motion", F.lit(0.0)) + 0.2 * F.col("coverage")
    a, b, c = weights
    return out.select(*keys, "norm_score", motion.alias("motion_score"), "diversity", (a * F.col("norm_score") + b * motion + c * F.col("diversity")).alias("importance"))


def same_group_similarity(rows: DataFrame, keys: list[str], item: str, vector: str) -> DataFrame:
    """Similarities of the pairs within a bounded group (the segments of one video): (keys, item, other, similarity)."""
    unit = rows.select(*keys, item, l2_normalize(vector, "clamp").alias("__v"))
    return unit.alias("a").join(unit.alias("b"), [*keys]).filter(F.col(f"a.{item}") != F.col(f"b.{item}")).select(*keys, F.col(f"a.{item}").alias(item), F.col(f"b.{item}").alias("other"), dot("a.__v", "b.__v").alias("similarity"))
