"""Frame hits merged into time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.config import RetrievalConfig
from framequarry.functions.vector import dot
from framequarry.operators.pooling import smoothmax_top_k
from framequarry.operators.topk import ranked


def islands(hits: DataFrame, keys: list[str], ts: str, gap: float, tie: str, vector: str | None = None, least: float = 0.9) -> DataFrame:
    """Hits with similarity (to the previous hit of the group) and island number.

    A hit joins the previous one's island if it comes at most ``gap`` later and, with a vector, is at least ``least`` alike.
    Vectors are dropped once the similarity to the previous row is known.
    """
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    out = hits.withColumn("__gap", F.col(ts) - F.lag(ts).over(order))
    if vector:
        out = out.withColumn("__prev", F.lag(vector).over(order)).withColumn("similarity", F.when(F.col("__prev").isNotNull(), dot("__prev", vector))).drop("__prev", vector)
        joined = (F.col("__gap") <= gap) & (F.col("similarity") >= least)
    else:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
        joined = F.col("__gap") <= gap
    fresh = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    out = out.withColumn("__new", fresh)
    return out.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("similarity", F.when(F.col("__new") == 0, F.col("similarity"))).drop("__gap", "__new")


def intervals(hits: DataFrame, keys: list[str], ts: str, score: str, tie: str, vector: str | None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(keys, island, start, stop, n, clip_score): 0.7 smooth maximum of the best scores and 0.3 mean similarity of neighbours."""
    marked = islands(hits, keys, ts, config.merge_gap, tie, vector, config.temporal_threshold)
    own = [*keys, "island"]
    spans = marked.groupBy(*own).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("n"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("__near"))
    smooth = smoothmax_top_k(marked, own, score, config.interval_top_k, config.interval_beta, "__smooth")
    value = config.interval_score_weight * F.col("__smooth") + config.interval_consistency_weight * F.col("__near")
    return spans.join(smooth, own).select(*own, "start", "stop", "n", value.alias("clip_score"))


def best_intervals(found: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The best intervals of each group in one array of struct(start, end, score), rounded as results are."""
    top = ranked(found, keys, [F.desc("clip_score"), F.asc("start")], limit)
    one = F.struct("rank", F.bround("start", 3).alias("start"), F.bround("stop", 3).alias("end"), F.bround("clip_score", 4).alias("score"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("segments"))


def tumbling(ts: Column, seconds: float, duration: Column | None = None) -> Column:
    """struct(segment_no, start, stop) of a fixed window; the last one ends with the video."""
    number = F.floor(ts / seconds).cast("int")
    start = number * F.lit(float(seconds))
    stop = start + seconds
    return F.struct(number.alias("segment_no"), start.alias("start"), (stop if duration is None else F.when(duration > 0, F.least(duration, stop)).otherwise(stop)).alias("stop"))
