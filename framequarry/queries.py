"""One query for each operator over the driver's tables, with the SQL that DuckDB answers it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.config import IndexConfig, RetrievalConfig, fetch_k
from framequarry.functions import captions, paths, sampling, vector
from framequarry.functions import text as X
from framequarry.operators import bm25, fusion, greedy, pooling, tables, temporal, topk
from framequarry.plans import engines
from framequarry.plans.encoders import HashEncoder
from framequarry.session import materialise, work_dir
from framequarry.sources import files
from framequarry.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- the entities of a media catalogue, from the driver's tables

FRAMES = """frames AS (SELECT vec_id AS frame_id, label AS video_id, embedding::DOUBLE[] AS e, rn, rn * CAST(0.5 AS DOUBLE) AS ts,
 label || '_seg_' || lpad((rn // 8)::VARCHAR, 4, '0') AS segment_id, 1 + (vec_id % 7) / CAST(10 AS DOUBLE) AS norm
 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings))"""
POOLED = """pooled AS (SELECT video_id, segment_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS e FROM (
 SELECT video_id, segment_id, list(m ORDER BY i) AS v FROM (SELECT video_id, segment_id, i, avg(e[i]) AS m FROM frames, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL))"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf, "embeddings").withColumn("rn", rn)
    return e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("video_id"), "embedding", "rn", (F.col("rn") * 0.5).alias("ts"), paths.segment_id("label", F.floor(F.col("rn") / 8)).alias("segment_id"), (1 + (F.col("vec_id") % 7) / 10.0).alias("norm"))


def some_queries(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """The first n vectors, as the query vectors of one request."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), "embedding")


def batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: each row whose id is divisible by 50."""
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("label"), "embedding")


# ---- vectors


@query("""SELECT query_id, item_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 1""")
def vec_topk(spark, sf):
    """The best item of each query, itself."""
    return topk.inner_product_topk(items(spark, sf), batch_queries(spark, sf), 1).select("query_id", "item_id", r6("score").alias("score"))


@query("""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def vec_topk_multi(spark, sf):
    found = topk.inner_product_topk(items(spark, sf), batch_queries(spark, sf), 10)
    return found.select("query_id", "item_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_zip(v, v2), lambda p: p[1] * p[2])), 6) AS dot, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM (
 SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: x * (1 + (vec_id % 7) / 10.0::DOUBLE)) AS v2 FROM embeddings)""")
def vec_dot(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("s", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 7 / 10.0)))
    return e.select("vec_id", r6(vector.dot("embedding", "s")).alias("dot"), r6(vector.norm("embedding")).alias("norm"))


@query("""SELECT vec_id, round(list_sum(u), 6) + 0.0::DOUBLE AS total, round(u[1], 6) + 0.0::DOUBLE AS first, round(sqrt(list_inner_product(u, u)), 6) AS norm FROM (SELECT vec_id,
 CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)::DOUBLE) AS v FROM embeddings)))""")
def vec_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 7)))
    e = e.withColumn("u", vector.l2_normalize("v"))
    return e.select("vec_id", (r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)) + 0.0).alias("total"), (r6(F.element_at("u", 1)) + 0.0).alias("first"), r6(vector.norm("u")).alias("norm"))


@query(f"""WITH {FRAMES}, {POOLED} SELECT a.segment_id, round((sum(list_inner_product(a.e, b.e)) - sum(CASE WHEN a.segment_id = b.segment_id THEN list_inner_product(a.e, b.e) ELSE 0 END)) / count(*), 6) AS genericness
 FROM pooled a, pooled b GROUP BY a.segment_id""")
def vec_genericness(spark, sf):
    return pooling.genericness(pooling.mean_pool(frames(spark, sf), ["video_id", "segment_id"], "embedding"), "segment_id", "embedding").select("segment_id", r6("genericness").alias("genericness"))


@query(f"""WITH {FRAMES} SELECT s.segment_id, round(coalesce(d, 0), 6) AS diversity FROM (SELECT DISTINCT segment_id FROM frames) s LEFT JOIN (SELECT a.segment_id, avg(1 - list_inner_product(a.e, b.e)) AS d
 FROM frames a JOIN frames b ON a.segment_id = b.segment_id AND a.frame_id < b.frame_id GROUP BY ALL) p ON s.segment_id = p.segment_id""")
def vec_diversity(spark, sf):
    return pooling.diversity(frames(spark, sf), ["segment_id"], "embedding").select("segment_id", r6("diversity").alias("diversity"))


@query(f"""WITH {FRAMES}, w AS (SELECT *, exp(norm - max(norm) OVER (PARTITION BY segment_id)) AS w FROM frames), p AS (SELECT segment_id, list(m ORDER BY i) AS v FROM (
 SELECT segment_id, i, sum(w * e[i]) / sum(w) AS m FROM w, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL)
 SELECT segment_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) AS total FROM p""")
def vec_attention_pool(spark, sf):
    p = pooling.attention_pool(frames(spark, sf), ["segment_id"], "embedding", "norm")
    return p.select("segment_id", r6(F.element_at("embedding", 1)).alias("first"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"WITH {FRAMES}, {POOLED} SELECT segment_id, round(e[1], 6) AS first, round(list_sum(e), 6) AS total FROM pooled")
def vec_mean_pool(spark, sf):
    p = pooling.mean_pool(frames(spark, sf), ["video_id", "segment_id"], "embedding")
    return p.select("segment_id", r6(F.element_at("embedding", 1)).alias("first"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {FRAMES}, {POOLED} SELECT a.video_id::BIGINT AS video_id, a.segment_id, b.segment_id AS other, round(list_inner_product(a.e, b.e), 6) AS similarity FROM pooled a JOIN pooled b ON a.video_id = b.video_id AND a.segment_id <> b.segment_id""")
def vec_same_video_similarity(spark, sf):
    p = pooling.mean_pool(frames(spark, sf), ["video_id", "segment_id"], "embedding")
    return pooling.same_group_similarity(p, ["video_id"], "segment_id", "embedding").select(F.col("video_id").cast("long").alias("video_id"), "segment_id", "other", r6("similarity").alias("similarity"))


# ---- score pooling

TOP_EVENTS = "top AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM (SELECT user_id, value / 100.0 AS s FROM events)), kept AS (SELECT * FROM top WHERE r <= 3)"


def scored_events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("value") / 100.0).alias("score"))


@query(f"WITH {TOP_EVENTS} SELECT user_id, round(avg(s), 6) AS average FROM kept GROUP BY 1")
def pool_topk_avg(spark, sf):
    return pooling.average_top_k(scored_events(spark, sf), ["user_id"], "score", 3).select("user_id", r6("average").alias("average"))


SMOOTH = "m + (ln(sum(exp((s - m) * {beta}))) - ln(count(*))) / {beta}"


@query(f"WITH {TOP_EVENTS}, k AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS m FROM kept) SELECT user_id, round(CASE WHEN count(*) = 1 THEN max(s) ELSE {SMOOTH.format(beta=12.0).replace('m +', 'max(m) +')} END, 6) AS smoothmax FROM k GROUP BY user_id")
def pool_smoothmax(spark, sf):
    return pooling.smoothmax_top_k(scored_events(spark, sf), ["user_id"], "score", 3, 12.0).select("user_id", r6("smoothmax").alias("smoothmax"))


@query(f"""WITH {TOP_EVENTS}, k AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS m FROM kept), g AS (SELECT user_id, count(*) AS n, max(s) AS hi, min(s) AS lo, avg(s) AS a, avg((s >= 0.18)::INT) AS ratio,
 {SMOOTH.format(beta=10.0).replace('m +', 'max(m) +')} AS sm FROM k GROUP BY user_id) SELECT user_id, round(CASE WHEN n = 1 THEN hi ELSE 0.65 * sm + 0.35 * a + 0.08 * ratio * lo - 0.06 * greatest(0, hi - a) * (1 - ratio) END, 6) AS consensus FROM g""")
def pool_consensus(spark, sf):
    return pooling.consensus_top_k(scored_events(spark, sf), ["user_id"], "score", 3).select("user_id", r6("consensus").alias("consensus"))


@query(f"""WITH {FRAMES} SELECT segment_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE least(1, greatest(0, (max(ts) - min(ts)) / 4.0)) END, 6) AS coverage FROM frames GROUP BY 1""")
def temporal_coverage(spark, sf):
    return pooling.temporal_coverage(frames(spark, sf).withColumn("len", F.lit(4.0)), ["segment_id"], "ts", "len").select("segment_id", r6("coverage").alias("coverage"))


@query(f"""WITH {FRAMES}, g AS (SELECT segment_id, avg(norm) AS norm_score, CASE WHEN count(*) <= 1 THEN 0 ELSE least(1, (max(ts) - min(ts)) / 4.0) END AS cov FROM frames GROUP BY 1),
 d AS (SELECT a.segment_id, avg(1 - list_inner_product(a.e, b.e)) AS d FROM frames a JOIN frames b ON a.segment_id = b.segment_id AND a.frame_id < b.frame_id GROUP BY 1)
 SELECT g.segment_id, round(0.2 * cov, 6) AS motion_score, round(norm_score + 0.2 * cov + coalesce(d, 0), 6) AS importance FROM g LEFT JOIN d ON g.segment_id = d.segment_id""")
def segment_importance(spark, sf):
    s = pooling.segment_importance(frames(spark, sf).withColumn("len", F.lit(4.0)), ["segment_id"], "embedding", "norm", "ts", "len")
    return s.select("segment_id", r6("motion_score").alias("motion_score"), r6("importance").alias("importance"))


@query("""SELECT user_id, round(coalesce(avg(abs(value - b)), 0), 6) AS motion FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1""")
def adjacent_motion(spark, sf):
    rows = table(spark, sf, "events").withColumn("grey", F.array("value"))
    return pooling.adjacent_motion(rows, ["user_id"], ["ts", "event_id"], "grey").select("user_id", r6("motion").alias("motion"))


# ---- text

TOK = r"list_transform(regexp_extract_all({}, '[0-9A-Za-z]+'), lambda t: lower(t))"


def oracle_tokens(text: str) -> str:
    return f"SELECT doc_id, t, min(p) AS p FROM (SELECT doc_id, unnest({TOK.format(text)}) AS t, generate_subscripts({TOK.format(text)}, 1) AS p FROM documents) GROUP BY ALL"


@query(f"WITH f AS ({oracle_tokens('text')}) SELECT d.doc_id, count(t)::BIGINT AS n_terms, md5(coalesce(string_agg(t, ' ' ORDER BY p), '')) AS terms_md5 FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id")
def tok_terms(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", X.tokens("text"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_type) THEN '' ELSE '' END || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM (SELECT *, list_concat([lower(p_brand)], list_transform(regexp_extract_all(p_brand, '[0-9A-Za-z]+'), lambda t: lower(t)), [lower(p_type)], list_transform(regexp_extract_all(p_type, '[0-9A-Za-z]+'), lambda t: lower(t))) AS l FROM part)".replace("CASE WHEN lower(p_brand) = lower(p_type) THEN '' ELSE '' END || ", ""))
def tok_tag_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.tag_terms(F.array("p_brand", "p_type")), " ").alias("terms"))


@query("SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:24], ' ') AS terms FROM (SELECT item_id, " + TOK.format("text") + " AS l FROM benchmark)")
def tok_query(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.query_terms("text"), " ").alias("terms"))


def search_docs(spark, sf, embed: bool = False) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.array("lang", "source").alias("tags"), F.col("text").alias("description"), F.lit("").alias("caption"), F.col("source").alias("video_path"))
    return engines.embed_documents(d, HashEncoder(), F.col("description")) if embed else d


def sparse_index(spark, sf) -> bm25.SparseIndex:
    d = search_docs(spark, sf)
    return bm25.build(bm25.term_fields(d, "video_id", F.col("tags"), F.col("description"), F.col("caption")), "video_id")


POSTINGS = f"""f AS ({oracle_tokens('text')}), fields AS (SELECT doc_id, t, 1.0 AS w FROM f UNION ALL
 SELECT doc_id, t, 1.0 FROM (SELECT doc_id, t FROM f UNION SELECT doc_id, lower(lang) FROM documents UNION SELECT doc_id, lower(source) FROM documents) UNION ALL
 SELECT doc_id, t, 2.0 FROM (SELECT doc_id, lower(lang) AS t FROM documents UNION SELECT doc_id, lower(source) FROM documents)),
 lens AS (SELECT d.doc_id, count(t) AS len FROM documents d LEFT JOIN fields USING (doc_id) GROUP BY 1), stats AS (SELECT count(*) AS n, avg(len) AS al FROM lens),
 postings AS (SELECT doc_id, t, sum(w) AS f FROM fields GROUP BY 1, 2)"""
BM25 = """df AS (SELECT t, count(*) AS df FROM postings WHERE t IN (SELECT t FROM q) GROUP BY t),
 idf AS (SELECT t, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
 hits AS (SELECT q.qid, p.doc_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))) AS s FROM q JOIN postings p USING (t) JOIN idf USING (t) JOIN lens USING (doc_id), stats GROUP BY 1, 2)"""


@query(f"WITH {POSTINGS} SELECT (SELECT n FROM stats)::BIGINT AS n_docs, round((SELECT al FROM stats), 6) AS avg_length, count(DISTINCT t)::BIGINT AS n_terms, count(*)::BIGINT AS n_postings FROM postings")
def bm25_stats(spark, sf):
    index = sparse_index(spark, sf)
    p = index.postings.agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings"))
    return index.stats.crossJoin(p).select("n_docs", r6("avg_length").alias("avg_length"), "n_terms", "n_postings")


@query(f"WITH {POSTINGS}, q AS (SELECT 0 AS qid, unnest(['the', 'thing', 'src3', 'fr']) AS t), {BM25} SELECT doc_id AS video_id, round(s, 6) AS sparse_score, row_number() OVER (ORDER BY s, doc_id) AS sparse_rank FROM hits ORDER BY s, doc_id LIMIT 100")
def bm25_search(spark, sf):
    q = spark.createDataFrame([(0, "the thing src3 fr")], "query_id int, text string")
    hits = bm25.search(sparse_index(spark, sf), bm25.query_rows(q, "text"))
    top = topk.rank_list(hits, [F.asc("sparse_score"), F.asc("video_id")], 100, "sparse_rank")
    return top.select("video_id", r6("sparse_score").alias("sparse_score"), F.col("sparse_rank").cast("long").alias("sparse_rank"))


@query(f"""WITH {POSTINGS}, q AS (SELECT DISTINCT item_id AS qid, t FROM (SELECT item_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:24]) AS t FROM (SELECT item_id, {TOK.format('text')} AS l FROM benchmark))), {BM25},
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9), doc_id) AS rank FROM hits) SELECT qid AS query_id, doc_id AS video_id, round(s, 6) AS sparse_score, rank FROM r WHERE rank <= 10""")
def bm25_search_batch(spark, sf):
    q = bm25.query_rows(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "text")
    hits = bm25.search(sparse_index(spark, sf), q)
    top = topk.ranked(hits, ["query_id"], [F.round("sparse_score", 9).asc(), F.asc("video_id")], 10)
    return top.select("query_id", "video_id", r6("sparse_score").alias("sparse_score"), F.col("rank").cast("long").alias("rank"))


# ---- fusion

LISTS = """o AS (SELECT l_orderkey AS k, max(l_extendedprice) AS price, max(l_quantity * l_discount) AS quantity FROM lineitem GROUP BY 1),
 a AS (SELECT k, row_number() OVER (ORDER BY price DESC, k) AS sr, price AS ss FROM o ORDER BY sr LIMIT 100), b AS (SELECT k, row_number() OVER (ORDER BY quantity DESC, k) AS dr, quantity AS ds FROM o ORDER BY dr LIMIT 100)"""


def two_lists(spark, sf):
    """Orders by their dearest line, and by their largest discounted quantity, over all lines."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.max("l_extendedprice").alias("sparse_score"), F.max(F.col("l_quantity") * F.col("l_discount")).alias("dense_score"))
    a = topk.rank_list(rows, [F.desc("sparse_score"), F.asc("video_id")], 100, "sparse_rank").select("video_id", "sparse_rank", "sparse_score")
    b = topk.rank_list(rows, [F.desc("dense_score"), F.asc("video_id")], 100, "dense_rank").select("video_id", "dense_rank", "dense_score")
    return a, b


@query(f"""WITH {LISTS}, f AS (SELECT coalesce(a.k, b.k) AS video_id, sr, dr, ss, ds, coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + dr), 0) AS score FROM a FULL JOIN b ON a.k = b.k)
 SELECT video_id, round(score, 6) AS score, sr::BIGINT AS sparse_rank, dr::BIGINT AS dense_rank FROM f ORDER BY f.score DESC, coalesce(nullif(ds, 0), -1), coalesce(sr, 10000) DESC, video_id LIMIT 20""")
def rrf_fusion(spark, sf):
    f = fusion.rrf_fuse(*two_lists(spark, sf)).orderBy(*fusion.fused_order()).limit(20)
    return f.select("video_id", r6("score").alias("score"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query(f"""WITH {LISTS}, u AS (SELECT k, 1.0::DOUBLE / (60 + sr) AS s, sr, NULL AS dr, 'first' AS src FROM a UNION ALL SELECT k, 1.0::DOUBLE / (60 + dr), NULL, dr, 'second' FROM b)
 SELECT k AS video_id, round(sum(s), 6) AS score, min(sr)::BIGINT AS sparse_rank, min(dr)::BIGINT AS dense_rank, string_agg(DISTINCT src, ',' ORDER BY src) AS sources, min(src) AS source_profile FROM u GROUP BY k""")
def federated_merge(spark, sf):
    a, b = two_lists(spark, sf)
    one = a.withColumns({"score": 1.0 / (60 + F.col("sparse_rank")), "dense_rank": F.lit(None).cast("int"), "dense_score": F.lit(None).cast("double")})
    two = b.withColumns({"score": 1.0 / (60 + F.col("dense_rank")), "sparse_rank": F.lit(None).cast("int"), "sparse_score": F.lit(None).cast("double")})
    m = fusion.federate([("first", one), ("second", two)])
    return m.select("video_id", r6("score").alias("score"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("dense_rank").cast("long").alias("dense_rank"), F.array_join("sources", ",").alias("sources"), "source_profile")


# ---- recall, rerank, intervals

ENGINE = f"""{FRAMES}, {POOLED}, n AS (SELECT count(*) AS n FROM pooled), gen AS (SELECT a.segment_id, (sum(list_inner_product(a.e, b.e)) - 1) / (SELECT n FROM n) AS g FROM pooled a, pooled b GROUP BY 1),
 seg AS (SELECT p.*, g, CAST(substr(p.segment_id, -4) AS INT) % 2 = 0 AS rep FROM pooled p JOIN gen USING (segment_id)), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 2)"""
RECALL_V = "rv AS (SELECT video_id, max(ip - 0.1 * g) AS rs FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, segment_id) AS r FROM (SELECT qid, segment_id, video_id, g, list_inner_product(seg.e, q.e) AS ip FROM seg, q WHERE rep)) WHERE r <= 12 GROUP BY 1 ORDER BY rs DESC, video_id LIMIT 5)"
RECALL_S = """rs AS (SELECT segment_id, video_id, max(ip) AS ss FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, segment_id) AS r FROM (SELECT qid, segment_id, video_id, list_inner_product(seg.e, q.e) AS ip FROM seg, q)) WHERE r <= 16 GROUP BY 1, 2),
 cs AS (SELECT * FROM rs WHERE video_id IN (SELECT video_id FROM rv) ORDER BY ss DESC, segment_id LIMIT 12)"""
RERANK = """fr AS (SELECT f.frame_id, f.segment_id, f.video_id, f.ts, f.e, max(list_inner_product(f.e, q.e)) AS clip FROM frames f, q WHERE f.segment_id IN (SELECT segment_id FROM cs) GROUP BY ALL),
 st AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY clip DESC) AS r FROM fr), sk AS (SELECT *, max(clip) OVER (PARTITION BY segment_id) AS m FROM st WHERE r <= 3),
 sup AS (SELECT segment_id, CASE WHEN count(*) = 1 THEN max(clip) ELSE 0.65 * (max(m) + (ln(sum(exp((clip - m) * 10.0))) - ln(count(*))) / 10.0) + 0.35 * avg(clip) + 0.08 * avg((clip >= 0.18)::INT) * min(clip) - 0.06 * greatest(0, max(clip) - avg(clip)) * (1 - avg((clip >= 0.18)::INT)) END AS sup FROM sk GROUP BY 1),
 ff AS (SELECT fr.*, 0.85 * clip + 0.2 * sup AS fs FROM fr JOIN sup USING (segment_id)),
 vt AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fs DESC) AS r FROM ff), vk AS (SELECT *, max(fs) OVER (PARTITION BY video_id) AS m FROM vt WHERE r <= 3),
 vs AS (SELECT video_id, CASE WHEN count(*) = 1 THEN max(fs) ELSE 0.65 * (max(m) + (ln(sum(exp((fs - m) * 10.0))) - ln(count(*))) / 10.0) + 0.35 * avg(fs) + 0.08 * avg((fs >= 0.18)::INT) * min(fs) - 0.06 * greatest(0, max(fs) - avg(fs)) * (1 - avg((fs >= 0.18)::INT)) END AS vscore FROM vk GROUP BY 1)"""


def video_engine(spark, sf, threshold: float = 0.0) -> engines.VideoEngine:
    f = frames(spark, sf)
    p = pooling.mean_pool(f, ["video_id", "segment_id"], "embedding")
    s = p.join(pooling.genericness(p, "segment_id", "embedding"), "segment_id").withColumns({"motion_score": F.lit(0.0), "is_representative": (F.substring("segment_id", -4, 4).cast("int") % 2 == 0).cast("int")})
    s = materialise(s, "segments")  # each step of the engine reads it
    return engines.VideoEngine(f, s, RetrievalConfig(video_recall=12, video_pool=5, segment_recall=16, segment_pool=12, temporal_threshold=threshold))


@query(f"WITH {ENGINE}, {RECALL_V} SELECT video_id::BIGINT AS video_id, round(rs, 6) AS score FROM rv")
def recall_video_max(spark, sf):
    return video_engine(spark, sf).recall_videos(some_queries(spark, sf, 2)).select(F.col("video_id").cast("long").alias("video_id"), r6("recall_score").alias("score"))


@query(f"WITH {ENGINE}, {RECALL_V}, {RECALL_S} SELECT segment_id, round(ss, 6) AS score FROM cs")
def recall_segment_max(spark, sf):
    e, q = video_engine(spark, sf), some_queries(spark, sf, 2)
    return e.recall_segments(q, e.recall_videos(q)).select("segment_id", r6("segment_score").alias("score"))


@query(f"WITH {ENGINE}, {RECALL_V}, {RECALL_S} SELECT segment_id, round(ss, 6) AS score FROM rs ORDER BY ss DESC, segment_id LIMIT 12")
def recall_candidate_fallback(spark, sf):
    e, q = video_engine(spark, sf), some_queries(spark, sf, 2)
    return e.recall_segments(q, e.recall_videos(q).limit(0)).select("segment_id", r6("segment_score").alias("score"))


@query(f"WITH {ENGINE}, {RECALL_V}, {RECALL_S}, {RERANK} SELECT frame_id, segment_id, round(clip, 6) AS clip_score, round(fs, 6) AS frame_score FROM ff")
def rerank_frames(spark, sf):
    e, q = video_engine(spark, sf), some_queries(spark, sf, 2)
    rows, _ = e.rerank(q, e.recall_segments(q, e.recall_videos(q)))
    return rows.select("frame_id", "segment_id", r6("clip_score").alias("clip_score"), r6("frame_score").alias("frame_score"))


@query(f"WITH {ENGINE}, {RECALL_V}, {RECALL_S}, {RERANK} SELECT video_id::BIGINT AS video_id, round(vscore, 6) AS score FROM vs")
def rerank_videos(spark, sf):
    e, q = video_engine(spark, sf), some_queries(spark, sf, 2)
    return e.rerank(q, e.recall_segments(q, e.recall_videos(q)))[1].select(F.col("video_id").cast("long").alias("video_id"), r6("video_score").alias("score"))


ISLANDS = """lg AS (SELECT *, lag(ts) OVER w AS pt, lag(e) OVER w AS pe FROM ff WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_id)), mk AS (SELECT *, CASE WHEN pt IS NOT NULL AND ts - pt <= 2.0 AND list_inner_product(pe, e) >= 0.0 THEN 0 ELSE 1 END AS nw, CASE WHEN pt IS NOT NULL THEN list_inner_product(pe, e) END AS sim FROM lg),
 il AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS island FROM mk), ir AS (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY fs DESC) AS r FROM il),
 ik AS (SELECT *, max(fs) OVER (PARTITION BY video_id, island) AS m FROM ir WHERE r <= 3), sm AS (SELECT video_id, island, CASE WHEN count(*) = 1 THEN max(fs) ELSE max(m) + (ln(sum(exp((fs - m) * 12.0))) - ln(count(*))) / 12.0 END AS sm FROM ik GROUP BY 1, 2),
 sp AS (SELECT video_id, island, min(ts) AS start, max(ts) AS stop, coalesce(avg(CASE WHEN nw = 0 THEN sim END), 0) AS near FROM il GROUP BY 1, 2), iv AS (SELECT sp.*, 0.7 * sm + 0.3 * near AS score FROM sp JOIN sm USING (video_id, island))"""


@query(f"WITH {ENGINE}, {RECALL_V}, {RECALL_S}, {RERANK}, {ISLANDS} SELECT video_id::BIGINT AS video_id, round(vscore, 4) AS score, n_intervals, best_start FROM (SELECT video_id, count(*)::BIGINT AS n_intervals, first(start ORDER BY score DESC, start) AS best_start FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start) AS r FROM iv) WHERE r <= 3 GROUP BY 1) JOIN vs USING (video_id)")
def video_search(spark, sf):
    out = video_engine(spark, sf).search(some_queries(spark, sf, 2), 50)
    return out.select(F.col("video_id").cast("long").alias("video_id"), F.round("score", 4).alias("score"), F.size("segments").cast("long").alias("n_intervals"), F.element_at("segments", 1)["start"].alias("best_start"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT user_id, island::BIGINT AS island, count(*)::BIGINT AS n, round(max(value), 6) AS peak, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS length_us FROM i GROUP BY 1, 2""")
def temporal_gap_merge(spark, sf):
    rows = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    marked = temporal.islands(rows, ["user_id"], "t", 7200 * 1_000_000, "event_id")
    return marked.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), r6(F.max("value")).alias("peak"), (F.max("t") - F.min("t")).alias("length_us"))


SEMANTIC = f"""WITH {FRAMES}, l AS (SELECT *, lag(ts) OVER w AS pt, lag(e) OVER w AS pe FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_id)), m AS (SELECT *, list_inner_product(pe, e) AS sim, CASE WHEN ts - pt <= 2.0 AND list_inner_product(pe, e) >= 0.1 THEN 0 ELSE 1 END AS nw FROM l),
 i AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


@query(f"{SEMANTIC} SELECT video_id::BIGINT AS video_id, island::BIGINT AS island, min(ts) AS start, max(ts) AS stop, count(*)::BIGINT AS n, round(coalesce(avg(CASE WHEN nw = 0 THEN sim END), 0), 6) AS near FROM i GROUP BY 1, 2")
def temporal_islands_semantic(spark, sf):
    marked = temporal.islands(frames(spark, sf), ["video_id"], "ts", 2.0, "frame_id", "embedding", 0.1)
    return marked.groupBy(F.col("video_id").cast("long").alias("video_id"), F.col("island").cast("long").alias("island")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"), r6(F.coalesce(F.avg("similarity"), F.lit(0.0))).alias("near"))


@query(f"""{SEMANTIC}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY norm DESC) AS r FROM i), k AS (SELECT *, max(norm) OVER (PARTITION BY video_id, island) AS m FROM t WHERE r <= 3),
 s AS (SELECT video_id, island, CASE WHEN count(*) = 1 THEN max(norm) ELSE max(m) + (ln(sum(exp((norm - m) * 12.0))) - ln(count(*))) / 12.0 END AS sm FROM k GROUP BY 1, 2), g AS (SELECT video_id, island, min(ts) AS start, max(ts) AS stop, coalesce(avg(CASE WHEN nw = 0 THEN sim END), 0) AS near FROM i GROUP BY 1, 2),
 o AS (SELECT g.*, 0.7 * sm + 0.3 * near AS score FROM g JOIN s USING (video_id, island)) SELECT video_id::BIGINT AS video_id, start, stop, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start) AS r FROM o) WHERE r <= 3""")
def temporal_interval_topn(spark, sf):
    found = temporal.intervals(frames(spark, sf), ["video_id"], "ts", "norm", "frame_id", "embedding", RetrievalConfig(temporal_threshold=0.1))
    top = topk.ranked(found, ["video_id"], [F.desc("clip_score"), F.asc("start")], 3)
    return top.select(F.col("video_id").cast("long").alias("video_id"), "start", "stop", r6("clip_score").alias("score"))


@query("SELECT event_id, floor(value / 4.0)::BIGINT AS segment_no, floor(value / 4.0) * 4.0 AS start, least(99.5::DOUBLE, floor(value / 4.0) * 4.0 + 4.0) AS stop FROM events")
def tumbling_segments(spark, sf):
    e = table(spark, sf, "events").withColumn("w", temporal.tumbling(F.col("value"), 4.0, F.lit(99.5)))
    return e.select("event_id", F.col("w.segment_no").cast("long").alias("segment_no"), "w.start", "w.stop")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n, round(max(value), 6) AS peak FROM i GROUP BY user_id, island""")
def stream_sessions(spark, sf):
    from framequarry.streaming.ingest import sessions

    s = sessions(table(spark, sf, "events"), "user_id", "ts", "value", "7200 seconds")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n", r6("peak").alias("peak"))


# ---- duplicates and greedy selection


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_md5(spark, sf):
    d = table(spark, sf, "documents").withColumn("md5", F.md5("text"))
    return greedy.first_per_content(d, "md5", "n_chars", "doc_id").select("doc_id", "source")


@query("""WITH RECURSIVE c AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS i, b.embedding::DOUBLE[] AS e, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 250),
 k AS (SELECT q, r, true AS taken, 1 AS rank, i, s, [e] AS kept FROM c WHERE r = 1 UNION ALL
 SELECT q, r, ok, rank + ok::INT, i, s, CASE WHEN ok THEN list_append(kept, e) ELSE kept END FROM (SELECT k.q, c.r, c.i, c.s, c.e, k.rank, k.kept,
 k.rank < 50 AND len(list_filter(k.kept, lambda v: list_inner_product(v, c.e) >= 0.3)) = 0 AS ok FROM k JOIN c ON k.q = c.q AND c.r = k.r + 1))
 SELECT q AS query_id, i AS item_id, round(s, 6) AS score, rank::BIGINT AS rank FROM k WHERE taken""")
def dedup_embedding(spark, sf):
    hits = topk.inner_product_topk(items(spark, sf), batch_queries(spark, sf), 250).join(items(spark, sf).select("item_id", "embedding"), "item_id")
    kept = greedy.suppress_near(hits, ["query_id"], "item_id", "score", "embedding", 0.3, 50)
    return kept.select("query_id", "item_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE {FRAMES}, {POOLED}, n AS (SELECT count(*) AS n FROM pooled), gen AS (SELECT a.segment_id, (sum(list_inner_product(a.e, b.e)) - 1) / (SELECT n FROM n) AS g FROM pooled a, pooled b GROUP BY 1),
 im AS (SELECT segment_id, avg(norm) AS nm, CASE WHEN count(*) <= 1 THEN 0 ELSE least(1, (max(ts) - min(ts)) / 4.0) END AS cov FROM frames GROUP BY 1),
 dv AS (SELECT a.segment_id, avg(1 - list_inner_product(a.e, b.e)) AS d FROM frames a JOIN frames b ON a.segment_id = b.segment_id AND a.frame_id < b.frame_id GROUP BY 1),
 seg AS (SELECT p.video_id, p.segment_id, p.e, nm + 0.2 * cov + coalesce(d, 0) - 0.35 * g AS base FROM pooled p JOIN gen USING (segment_id) JOIN im USING (segment_id) LEFT JOIN dv USING (segment_id)),
 k AS (SELECT video_id, 0 AS step, NULL::VARCHAR AS last, []::VARCHAR[] AS chosen, []::DOUBLE[][] AS vecs FROM (SELECT DISTINCT video_id FROM seg) UNION ALL
 SELECT video_id, step + 1, arg_max(segment_id, (score, -no)), list_append(any_value(chosen), arg_max(segment_id, (score, -no))), list_append(any_value(vecs), arg_max(e, (score, -no))) FROM
 (SELECT k.video_id, k.step, k.chosen, k.vecs, s.segment_id, s.e, CAST(substr(s.segment_id, -4) AS INT) AS no, s.base - 0.25 * coalesce(list_max(list_transform(k.vecs, lambda v: list_inner_product(v, s.e))), 0) AS score
 FROM k JOIN seg s ON k.video_id = s.video_id AND NOT list_contains(k.chosen, s.segment_id) WHERE k.step < 8) GROUP BY video_id, step)
 SELECT video_id::BIGINT AS video_id, last AS segment_id, step::BIGINT AS rank FROM k WHERE step > 0""")
def mmr_representatives(spark, sf):
    s = engines.build_segments(frames(spark, sf))
    found = greedy.representatives(s.drop("rank"), ["video_id"], "segment_id", "importance", "genericness", "embedding")
    return found.select(F.col("video_id").cast("long").alias("video_id"), "segment_id", F.col("rank").cast("long").alias("rank"))


# Seeds farthest first (sd), rounds (ll), candidates by cluster (cand), then one cluster after the other and the rest by norm (tk).
CLUSTERS = """g AS (SELECT segment_id, list(frame_id ORDER BY ts, frame_id) AS id, list(e ORDER BY ts, frame_id) AS v, list(norm ORDER BY ts, frame_id) AS nm, list(ts ORDER BY ts, frame_id) AS t, count(*)::INT AS n, least(4, count(*))::INT AS k FROM frames GROUP BY 1),
 sd AS (SELECT segment_id, v, k, 1 AS s, [top] AS seeds, list_transform(v, lambda x, i: CASE WHEN i = top THEN 1e9 ELSE list_inner_product(x, v[top]) END) AS near FROM (SELECT *, list_position(nm, list_max(nm)) AS top FROM g) UNION ALL
 SELECT segment_id, v, k, s + 1, list_append(seeds, far), list_transform(v, lambda x, i: CASE WHEN i = far OR near[i] > 1e8 THEN 1e9 ELSE greatest(near[i], list_inner_product(x, v[far])) END) FROM (SELECT *, list_position(near, list_min(near)) AS far FROM sd WHERE s < k)),
 ll AS (SELECT g.segment_id, g.v, g.nm, g.n, g.k, 0 AS r, list_transform(seeds, lambda i: g.v[i]) AS c, list_transform(g.v, lambda x: 1) AS own, false AS still FROM g JOIN sd ON g.segment_id = sd.segment_id AND sd.s = g.k UNION ALL
 SELECT segment_id, v, nm, n, k, r + 1, CASE WHEN latest = own THEN c ELSE list_transform(range(1, k + 1), lambda j: CASE WHEN list_contains(latest, j) THEN list_transform(range(1, 65), lambda d: list_sum(list_transform(list_filter(range(1, n + 1), lambda i: latest[i] = j), lambda i: v[i][d]))) ELSE v[list_position(nm, list_max(nm))] END) END, latest, latest = own
 FROM (SELECT *, list_transform(v, lambda x: list_position(list_transform(c, lambda y: list_inner_product(x, y)), list_max(list_transform(c, lambda y: list_inner_product(x, y))))) AS latest FROM (SELECT segment_id, v, nm, n, k, r, own, still, list_transform(c, lambda y: list_transform(y, lambda z: z / sqrt(list_inner_product(y, y)))) AS c FROM ll) WHERE r < 12 AND NOT still)),
 fin AS (SELECT segment_id, arg_max(c, r) AS c, arg_max(own, r) AS own FROM ll GROUP BY 1),
 cand AS (SELECT segment_id, k, i, frame_id, x, n, t, 0.75 * n + 0.25 * list_inner_product(x, cc) AS sc, cl FROM (SELECT g.segment_id, k, i, id[i] AS frame_id, v[i] AS x, nm[i] AS n, t[i] AS t, own[i] AS cl, list_transform(fin.c[own[i]], lambda z: z / sqrt(list_inner_product(fin.c[own[i]], fin.c[own[i]]))) AS cc FROM g JOIN fin USING (segment_id), range(1, 9) u(i) WHERE i <= g.n)),
 od AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, i) AS place FROM cand),
 tk AS (SELECT segment_id, n, k, 1 AS s, []::BIGINT[] AS taken, []::DOUBLE[][] AS vecs FROM g UNION ALL
 SELECT segment_id, n, k, s + 1, CASE WHEN i IS NULL THEN taken ELSE list_append(taken, i) END, CASE WHEN i IS NULL THEN vecs ELSE list_append(vecs, x) END FROM
 (SELECT t.segment_id, t.n, t.k, s, any_value(taken) AS taken, any_value(vecs) AS vecs, arg_max(t.i, (sc, -t.i)) FILTER (free) AS i, arg_max(t.x, (sc, -t.i)) FILTER (free) AS x FROM (SELECT tk.segment_id, tk.n, tk.k, tk.s, tk.taken, tk.vecs, od.i, od.x, od.sc,
 len(taken) < tk.k AND NOT list_contains(taken, od.i) AND len(list_filter(vecs, lambda y: list_inner_product(y, od.x) >= 0.3)) = 0 AS free FROM tk JOIN od ON tk.segment_id = od.segment_id AND CASE WHEN s <= tk.k THEN od.cl = s ELSE od.place = s - tk.k END
 UNION ALL SELECT tk.segment_id, tk.n, tk.k, tk.s, tk.taken, tk.vecs, NULL, NULL, NULL, false FROM tk) t WHERE s <= k + n GROUP BY 1, 2, 3, 4))"""


@query(f"""WITH RECURSIVE {FRAMES}, {CLUSTERS}
 SELECT segment_id, frame_id, (row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, t) )::BIGINT AS rank FROM (SELECT tk.segment_id, unnest(taken) AS i FROM tk WHERE s = k + n + 1) p JOIN cand USING (segment_id, i)""")
def kmeans_frame_select(spark, sf):
    found = greedy.select_frames(frames(spark, sf), ["segment_id"], "frame_id", "embedding", "norm", "ts", IndexConfig(dedupe_threshold=0.3))
    return found.select("segment_id", "frame_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 k AS (SELECT user_id, 0 AS pos, event_id, value, r FROM e WHERE r = 1 UNION ALL
 SELECT k.user_id, k.pos + 1, arg_min(e.event_id, e.r), arg_min(e.value, e.r), min(e.r) FROM k JOIN e ON k.user_id = e.user_id AND e.r > k.r AND abs(e.value - k.value) / 255.0::DOUBLE >= 30.0::DOUBLE / 255.0::DOUBLE WHERE k.pos < 15 GROUP BY k.user_id, k.pos)
 SELECT user_id, pos, event_id FROM k""")
def scene_changes(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("idx"), F.array("value").alias("sig")))).alias("s"))
    return rows.select("user_id", F.posexplode(greedy.scene_changes(F.col("s"), 30.0 / 255.0, 4, 255.0)).alias("pos", "event_id"))


@query("SELECT n, k, CASE WHEN n <= 0 OR k <= 0 THEN 0 ELSE least(n, greatest(k, 5 * k, k + 40)) END AS fetch_k FROM (SELECT unnest([0, 5, 30, 60, 1000]) AS n), (SELECT unnest([0, 1, 10, 50]) AS k)")
def fetch_k_table(spark, sf):
    rows = [(n, k, fetch_k(k, n)) for n in (0, 5, 30, 60, 1000) for k in (0, 1, 10, 50)]
    return spark.createDataFrame(rows, "n int, k int, fetch_k int")


# ---- joins and filters


@query("""SELECT o.o_orderkey, l.l_linenumber, c.c_custkey, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_frames_segments_videos(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), "l_linenumber")
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("video_id"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), "c_name")
    return tables.frames_with_parents(f, s, v).select(F.col("segment_id").alias("o_orderkey"), "l_linenumber", F.col("video_id").alias("c_custkey"), "c_name")


@query("""SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def join_lookup_left(spark, sf):
    records = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("path"))
    out = tables.lookup(table(spark, sf, "documents").select("doc_id"), records.withColumn("hit", F.lit(1)), "doc_id")
    return out.select("doc_id", F.when(F.col("hit").isNull(), -1).otherwise(F.col("path")).cast("long").alias("quality"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def semi_candidates(spark, sf):
    return tables.candidates_or_all(table(spark, sf, "documents"), table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_pending(spark, sf):
    return tables.select_videos(table(spark, sf, "documents"), "doc_id", done=table(spark, sf, "labels")).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a_e%' AND lower(p_brand) LIKE '%#1%' AND lower(p_type) LIKE '%e%'")
def filter_attributes(spark, sf):
    return tables.attribute_filter(table(spark, sf, "part"), {"p_name": "A_e", "p_brand": "#1", "p_type": "E", "p_size": " "}).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND (o_custkey % 3 = 0 OR coalesce(o_orderdate > CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '1995-06-01' END, false)))""")
def filter_stale_embeddings(spark, sf):
    o = table(spark, sf, "orders").withColumns({"status": F.when(F.col("o_orderstatus") == "O", "caption_done").when(F.col("o_orderstatus") == "F", "done").otherwise("other"), "emb": F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.lit("1995-06-01").cast("timestamp_ntz")), "cap": F.col("o_orderdate").cast("timestamp_ntz")})
    return o.filter(tables.needs_embedding("status", F.col("o_custkey") % 3 != 0, "cap", "emb")).select("o_orderkey", "o_orderstatus")


# ---- merges

UPSERT = "t AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_suppkey % 3 <> 0), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE upper(s_name) || '!' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE -s_acctbal END AS bal FROM supplier WHERE s_suppkey % 2 = 0)"


def upsert_sides(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "k")
    t = s.filter("k % 3 <> 0").select("k", F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    n = s.filter("k % 2 = 0").select("k", F.expr("CASE WHEN k % 4 = 0 THEN NULL ELSE upper(s_name) || '!' END").alias("name"), F.expr("CASE WHEN k % 5 = 0 THEN NULL ELSE -s_acctbal END").alias("bal"))
    return t, n


@query(f"WITH {UPSERT} SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, coalesce(s.bal, t.bal) AS bal FROM t FULL JOIN s ON t.k = s.k")
def upsert_coalesce(spark, sf):
    return tables.merge(*upsert_sides(spark, sf), tables.MergeSpec(("k",), ("name",), ("bal",)))


@query(f"WITH {UPSERT} SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.bal ELSE s.bal END AS bal FROM t FULL JOIN s ON t.k = s.k")
def upsert_replace(spark, sf):
    return tables.merge(*upsert_sides(spark, sf), tables.MergeSpec(("k",), ("name", "bal")))


@query(f"WITH {UPSERT} SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NOT NULL THEN t.name ELSE s.name END AS name, CASE WHEN t.k IS NOT NULL THEN t.bal ELSE s.bal END AS bal FROM t FULL JOIN s ON t.k = s.k")
def upsert_ignore(spark, sf):
    return tables.merge(*upsert_sides(spark, sf), tables.MergeSpec(("k",), ("name", "bal"), update=False))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def delete_cascade(spark, sf):
    segments = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("video_id"))
    parts = {"segments": segments, "frames": table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "segment_id")}
    out = tables.delete_cascade(parts, segments.filter("video_id % 10 = 0").select("video_id").distinct())
    return out["frames"].select(F.col("segment_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT user_id, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value, arg_max(event_type, CASE WHEN event_type <> 'click' THEN event_id END) AS event_type FROM events GROUP BY 1")
def last_record_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.nullif(F.col("event_type"), F.lit("click")).alias("event_type"), F.col("event_id").alias("o"))
    return tables.last_per_key(e, ["user_id"], "o", ("event_type",)).select("user_id", "event_id", r6("value").alias("value"), "event_type")


@query("SELECT source, min(doc_id) AS pos FROM documents GROUP BY 1")
def first_seen_order(spark, sf):
    return tables.first_seen(table(spark, sf, "documents"), "source", "doc_id")


@query("SELECT 'incremental' AS mode, 4::BIGINT AS adds, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS n_append UNION ALL SELECT 'full', 0, 0 UNION ALL SELECT 'noop', 3, 0")
def index_sync_mode(spark, sf):
    d, known = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    new = d.join(known, "doc_id", "left_anti")
    rows = [tables.sync_mode(new, known, "doc_id", True, False, 3), tables.sync_mode(d, known, "doc_id", True, False, 3), tables.sync_mode(d.limit(0), known, "doc_id", True, False, 3)]
    return rows[0].union(rows[1]).union(rows[2]).select("mode", F.col("adds").cast("long").alias("adds"), "n_append")


TASKS = "SELECT o_orderkey AS video_id, stage, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'done' ELSE 'pending' END AS status, (o_orderkey % 5)::BIGINT AS retry_count FROM orders, (SELECT unnest(['segment', 'frame_extract', 'embedding', 'topk']) AS stage)"


def task_rows(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"))
    t = v.select("video_id", F.explode(F.array(*[F.lit(s) for s in tables.STAGES])).alias("stage"))
    return t.select(F.concat_ws(":", "video_id", "stage").alias("task_id"), "video_id", "stage", F.expr("CASE WHEN video_id % 4 = 0 THEN 'failed' WHEN video_id % 4 = 1 THEN 'done' ELSE 'pending' END").alias("status"), F.lit(2).alias("max_retry"), (F.col("video_id") % 5).alias("retry_count"), F.lit(None).cast("string").alias("error_message"))


@query(f"WITH t AS ({TASKS}) SELECT video_id, stage, CASE WHEN status = 'done' THEN 'skip' WHEN status = 'failed' AND retry_count >= 2 THEN 'raise' ELSE 'run' END AS action, CASE WHEN stage = 'topk' THEN retry_count + 1 ELSE retry_count END AS retries, CASE WHEN stage = 'topk' THEN 'failed' ELSE status END AS after FROM t")
def task_transition(spark, sf):
    t = task_rows(spark, sf)
    out = tables.update_tasks(t, t.filter("stage = 'topk'").select("task_id", F.lit("failed").alias("new_status"), F.lit("x").alias("error")))
    before = t.select("task_id", tables.task_action().alias("action"))
    return out.join(before, "task_id").select("video_id", "stage", "action", F.col("retry_count").cast("long").alias("retries"), F.col("status").alias("after"))


@query(f"WITH t AS ({TASKS}) SELECT video_id, stage, CASE WHEN video_id IN (1, 2, 3) AND stage IN ('embedding', 'topk') THEN 'pending' ELSE status END AS status, retry_count FROM t")
def task_reset_cascade(spark, sf):
    return tables.reset_tasks(task_rows(spark, sf), [1, 2, 3], "embedding").select("video_id", "stage", "status", "retry_count")


# ---- captions, arrays, paths


@query("""SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM (SELECT event_id, list_filter(list_transform(string_split_regex(event_type || ' ;' || event_type || '|, x' || (event_id % 3)::VARCHAR || '、', '[,，;；、|]+'), lambda t: trim(t)), lambda t: t <> '') AS l FROM events)""")
def tags_normalize(spark, sf):
    raw = F.concat("event_type", F.lit(" ;"), "event_type", F.lit("|, x"), (F.col("event_id") % 3).cast("string"), F.lit("、"))
    return table(spark, sf, "events").select("event_id", F.array_join(captions.normalize_tags(raw), ",").alias("tags"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS description, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'cap' ELSE event_type END AS caption, try_cast(value AS DOUBLE) AS duration FROM events")
def caption_normalize(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("videoID"), F.expr("CASE WHEN event_id % 4 IN (2, 3) THEN ' ' || event_type || ' ' WHEN event_id % 4 = 1 THEN event_type END").alias("caption_description"), F.expr("CASE WHEN event_id % 4 = 1 THEN 'cap' ELSE ' ' END").alias("caption_text"), F.col("value").cast("string").alias("duration"))
    return captions.normalize_records(e).select(F.col("video_id").cast("long").alias("event_id"), "status", "description", "caption", F.col("duration_seconds").alias("duration"))


@query("SELECT event_id, regexp_extract('note ' || props || ' end', '(?s)\\{.*\\}') AS json FROM events")
def json_extract_first(spark, sf):
    return table(spark, sf, "events").select("event_id", captions.first_json_object(F.concat(F.lit("```json\nnote "), F.col("props"), F.lit(" end\n```"))).alias("json"))


@query("SELECT event_id, array_to_string(['a', event_type], ',') AS tags, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'd' END AS description, CASE WHEN event_id % 3 = 0 THEN 'no description' END AS error FROM events")
def caption_parse(spark, sf):
    answer = F.concat(F.lit('```json\n{"tags": ["a", "'), F.col("event_type"), F.lit('"], "description": "'), F.when(F.col("event_id") % 3 == 0, "").otherwise("d"), F.lit('"}\n```'))
    return table(spark, sf, "events").select("event_id", captions.parse_video_caption(answer).alias("p")).select("event_id", F.array_join("p.tags", ",").alias("tags"), "p.description", "p.error")


@query("SELECT n, k, list_sort(list_distinct(list_transform(range(k), lambda i: CASE WHEN k = 1 THEN 0 ELSE round_even(i * (n - 1) / (k - 1)::DOUBLE, 0) END::INT)))::VARCHAR AS indices FROM (SELECT unnest([20, 57, 100]) AS n), (SELECT unnest([1, 2, 5, 8]) AS k)")
def uniform_sample(spark, sf):
    rows = spark.createDataFrame([(n, k) for n in (20, 57, 100) for k in (1, 2, 5, 8)], "n int, k int")
    return rows.select("n", "k", sampling.uniform_indices("n", "k").cast("string").alias("indices"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^[^/]*/', '') AS rel, 'media/' || regexp_replace(regexp_replace(url, '^https?://', ''), '^[^/]*/', '') AS back FROM pages")
def path_portable(spark, sf):
    p = table(spark, sf, "pages").withColumn("rel", F.regexp_replace("url", "^https?://[^/]*/", ""))
    absolute = F.concat(F.lit("C:\\old\\media\\"), F.replace(F.col("rel"), F.lit("/"), F.lit("\\")))
    portable = paths.make_portable(paths.resolve_portable(absolute, "/srv/media"), "/srv/media")
    return p.select("page_id", portable.alias("rel"), F.concat(F.lit("media/"), portable).alias("back"))


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'plain/' || substr(url, 8) WHEN url LIKE 'https://%' THEN 'safe/' || substr(url, 9) ELSE url END AS path FROM pages")
def path_rewrite(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.rewrite_prefix("url", [("HTTP://", "plain/"), ("https://", "safe/"), ("http", "never/")]).alias("path"))


@query(f"WITH {FRAMES} SELECT frame_id, video_id::VARCHAR || '::' || segment_id AS item, segment_id || '_f' || lpad(rn::VARCHAR, 6, '0') AS name, (regexp_extract(segment_id, '([0-9]+)$', 1))::BIGINT AS number FROM frames")
def path_ids(spark, sf):
    f = frames(spark, sf).withColumn("item", paths.item_id("video_id", "segment_id"))
    return f.select("frame_id", "item", paths.frame_id(paths.split_item("item")["segment_id"], "rn").alias("name"), captions.video_index("segment_id").alias("number"))


@query("""WITH a AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) AS r FROM embeddings), b AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) DESC, vec_id) AS r FROM embeddings)
 SELECT coalesce(x.image_id, y.image_id) AS image_id, x.r::BIGINT AS left_rank, y.r::BIGINT AS right_rank, (x.r IS NOT NULL AND y.r IS NOT NULL) AS in_both FROM (SELECT * FROM a WHERE r <= 20) x FULL JOIN (SELECT * FROM b WHERE r <= 20) y ON x.image_id = y.image_id""")
def dual_compare(spark, sf):
    index, q = items(spark, sf).withColumnRenamed("item_id", "image_id"), some_queries(spark, sf, 2)
    lists = [topk.inner_product_topk(index, q.filter(F.col("query_id") == i), 20, item="image_id") for i in (0, 1)]
    out = engines.dual_compare(*lists)
    return out.select("image_id", F.col("left_rank").cast("long").alias("left_rank"), F.col("right_rank").cast("long").alias("right_rank"), "in_both")


@query("""WITH c AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s FROM embeddings), f AS (SELECT * FROM c ORDER BY s DESC, vec_id LIMIT 50), k AS (SELECT *, row_number() OVER (PARTITION BY label % 5, vec_id // 2 ORDER BY s DESC, vec_id) AS d FROM f)
 SELECT vec_id AS image_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM k WHERE d = 1 ORDER BY s DESC, vec_id LIMIT 10""")
def picture_search(spark, sf):
    images = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat_ws("-", F.col("label") % 5, F.floor(F.col("vec_id") / 2)).alias("md5"), F.lit(None).cast("string").alias("path"), "embedding")
    q = table(spark, sf, "embeddings").filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    return engines.PictureEngine(images).search(q, 10).select("image_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


class Stored:
    """An encoder that gives one vector to whatever text."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


def with_vectors(spark, sf) -> tuple[DataFrame, Stored]:
    """Documents with the vector of their number, if there is one; queries have that of number 3."""
    e = table(spark, sf, "embeddings")
    docs = search_docs(spark, sf).join(e.select(F.col("vec_id").alias("video_id"), "embedding"), "video_id", "left")
    return docs, Stored([float(x) for x in e.filter("vec_id = 3").first().embedding])


@query(f"""WITH {POSTINGS}, q AS (SELECT 0 AS qid, unnest(['the', 'thing', 'of', 'that', 'src3']) AS t), {BM25}, a AS (SELECT doc_id AS k, s AS ss, row_number() OVER (ORDER BY s, doc_id) AS sr FROM hits ORDER BY sr LIMIT 100),
 d AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS ds FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), b AS (SELECT vec_id AS k, ds, row_number() OVER (ORDER BY ds DESC, vec_id) AS dr FROM d ORDER BY dr LIMIT 100),
 fu AS (SELECT coalesce(a.k, b.k) AS video_id, sr, dr, ds, coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + dr), 0) AS score FROM a FULL JOIN b ON a.k = b.k)
 SELECT video_id, round(score, 6) AS score, sr::BIGINT AS sparse_rank, dr::BIGINT AS dense_rank FROM fu ORDER BY fu.score DESC, coalesce(nullif(ds, 0), -1), coalesce(sr, 10000) DESC, video_id LIMIT 10""")
def hybrid_search(spark, sf):
    out = engines.HybridEngine(*with_vectors(spark, sf)).search("the thing of that src3", 10)
    return out.select("video_id", r6("score").alias("score"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query("SELECT doc_id, (trim(text) <> '')::BOOLEAN AS has_vector, CASE WHEN trim(text) <> '' THEN 1.0::DOUBLE END AS norm FROM documents")
def encode_documents(spark, sf):
    """Vectors of all texts by the hash encoder, known by their norms."""
    d = engines.embed_documents(table(spark, sf, "documents"), HashEncoder(), F.col("text"))
    return d.select("doc_id", F.col("embedding").isNotNull().alias("has_vector"), F.round(vector.norm("embedding"), 6).alias("norm"))


# Full-width letters, a ligature, CJK runs of one, two and six characters: what normalisation and the runs' pieces must give.
WIDE = [(1, "ＡＢＣ ﬁne 猫", "abc fine 猫"), (2, "視頻檢索系統 demo", "視頻 頻檢 檢索 索系 系統 視頻檢 頻檢索 檢索系 索系統 demo"), (3, "猫犬 ①２", "猫犬 12"), (4, "  ", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}', '{want}')" for i, _, want in WIDE) + ") t(id, terms, indexed)")
def tok_wide(spark, sf):
    d = spark.createDataFrame([r[:2] for r in WIDE], "id int, text string")
    fields = bm25.term_fields(d, "id", F.array().cast("array<string>"), F.col("text"), F.lit(None).cast("string"))
    return d.select("id", F.array_join(X.tokens("text", nfkc=True), " ").alias("terms")).join(fields.select("id", F.col("description_terms").alias("indexed")), "id")


# ---- selection, maintenance and small set operators


@query("SELECT s_suppkey, s_name FROM (SELECT * FROM (SELECT *, try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM supplier) WHERE n BETWEEN 3 AND 60 ORDER BY s_suppkey LIMIT 30) WHERE s_suppkey % 7 <> 0")
def select_videos(spark, sf):
    s = table(spark, sf, "supplier").withColumn("n", captions.video_index("s_name")).filter("n between 3 and 60").drop("n")
    return tables.select_videos(s, "s_suppkey", limit=30, done=table(spark, sf, "supplier").filter("s_suppkey % 7 = 0")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN true ELSE false END AS skip, o_orderstatus = 'F' AS skip_retry FROM (SELECT o_orderkey, o_orderstatus FROM orders)")
def skip_rules(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error")
    return table(spark, sf, "orders").select("o_orderkey", tables.should_skip(status, False, False).alias("skip"), tables.should_skip(status, False, True).alias("skip_retry"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE trim(text) <> '' AND lang <> 'en')::BIGINT AS structured FROM documents")
def structured_counts(spark, sf):
    d = table(spark, sf, "documents").withColumn("tags", F.filter(F.array("lang"), lambda t: t != "en"))
    return d.agg(F.count("*").alias("total"), F.count_if(tables.structured("text", "tags")).alias("structured"))


@query("SELECT pos, n.n_nationkey, n.n_name FROM nation n JOIN (SELECT unnest([7, 3, 24, 0, 11]) AS k, unnest([0, 1, 2, 3, 4]) AS pos) o ON n.n_nationkey = o.k")
def reorder_by_ids(spark, sf):
    return topk.in_order(table(spark, sf, "nation"), "n_nationkey", [7, 3, 24, 0, 11, 3]).select("pos", "n_nationkey", "n_name")


@query(f"WITH {FRAMES}, s AS (SELECT DISTINCT video_id, segment_id FROM frames), c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY segment_id DESC) AS r FROM s WHERE video_id < 5) SELECT s.segment_id, CASE WHEN s.video_id < 5 THEN c.r ELSE 9 END::BIGINT AS rank, CASE WHEN s.video_id < 5 THEN (c.r IS NOT NULL)::INT ELSE 1 END AS flag FROM s LEFT JOIN (SELECT * FROM c WHERE r <= 3) c ON s.segment_id = c.segment_id")
def flag_representatives(spark, sf):
    s = frames(spark, sf).select("video_id", "segment_id").distinct().withColumns({"representative_rank": F.lit(9), "is_representative": F.lit(1)})
    chosen = topk.ranked(s.filter("video_id < 5").select("video_id", "segment_id"), ["video_id"], [F.desc("segment_id")], 3)
    return tables.flag_representatives(s, chosen).select("segment_id", F.col("representative_rank").cast("long").alias("rank"), F.col("is_representative").alias("flag"))


@query(f"WITH t AS ({TASKS}) SELECT video_id, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status <> 'done') = 0 THEN 'done' WHEN count(*) FILTER (WHERE status <> 'pending') > 0 THEN 'processing' ELSE 'pending' END AS status FROM t GROUP BY 1")
def video_states(spark, sf):
    return tables.video_state(task_rows(spark, sf)).select("video_id", "status")


@query("SELECT o_orderkey AS video_id, stage, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'pending' END ELSE 'pending' END AS status FROM orders, (SELECT unnest(['segment', 'frame_extract', 'embedding', 'topk']) AS stage)")
def ensure_tasks(spark, sf):
    t = task_rows(spark, sf)
    return tables.ensure_tasks(t.filter("video_id % 2 = 0"), t.select("video_id").distinct()).select("video_id", "stage", "status")


@query("SELECT o_custkey AS video_id, bool_and(has AND n > 0 AND missing = 0) AS ready FROM (SELECT o.o_custkey, o.o_orderkey % 11 <> 0 AS has, count(l.l_orderkey) AS n, count(*) FILTER (WHERE l.l_quantity < 2) AS missing FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, o.o_orderkey) GROUP BY 1")
def outputs_ready(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_orderkey") % 11 != 0, 1).alias("embedding"))
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.when(F.col("l_quantity") >= 2, 1).alias("embedding"))
    return tables.outputs_ready(s, f).select("video_id", "ready")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS records_indexed, (SELECT count(*) FROM labels)::BIGINT AS records_encoded, ((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels))::BIGINT AS records_reused, 'full' AS last_build_mode, 0 AS incremental_adds")
def build_manifest(spark, sf):
    from framequarry.sources.files import manifest

    return manifest(table(spark, sf, "documents"), table(spark, sf, "labels"), "full", 0)


@query("SELECT event_id, event_id % 15 = 0 AND least(100 + event_id % 50, 130) >= 128 AS keep FROM events")
def frame_rule(spark, sf):
    return table(spark, sf, "events").select("event_id", sampling.keep_frame("event_id", 100 + F.col("event_id") % 50, F.lit(130), 30.0, 2.0).alias("keep"))


@query("SELECT p_partkey, greatest(1, round_even((p_size * 40) * least(1.0, 640.0 / greatest(p_size * 40, 480)), 0))::INT AS width, greatest(1, round_even(480 * least(1.0, 640.0 / greatest(p_size * 40, 480)), 0))::INT AS height FROM part")
def resize_dims(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sampling.fit_within(F.col("p_size") * 40, F.lit(480), 640).alias("d")).select("p_partkey", "d.width", "d.height")


SPREAD = "list_transform(range({k}), lambda i: {l}[round_even(i * (len({l}) - 1) / ({k} - 1)::DOUBLE, 0)::INT + 1])"


@query(f"""WITH s AS (SELECT user_id, list_sort(list_distinct(list(trunc(value * 3)::INT))) AS s FROM events GROUP BY 1), f AS (SELECT list_transform(range(8), lambda i: round_even(i * 299 / 7::DOUBLE, 0)::INT) AS whole, list_transform(range(4), lambda i: round_even(i * 299 / 3::DOUBLE, 0)::INT) AS even),
 x AS (SELECT *, list_filter(s, lambda v: NOT list_contains(even, v)) AS e FROM s, f), m AS (SELECT user_id, whole, list_sort(list_distinct(list_concat(even, CASE WHEN len(e) <= 4 THEN e ELSE {SPREAD.format(k=4, l='e')} END))) AS m FROM x),
 p AS (SELECT user_id, CASE WHEN len(m) < 8 THEN list_sort(list_distinct(list_concat(m, whole))) ELSE m END AS p FROM m) SELECT user_id, array_to_string(CASE WHEN len(p) <= 8 THEN p ELSE {SPREAD.format(k=8, l='p')} END, ',') AS frames FROM p""")
def keyframe_choice(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("value") * 3).cast("int"))).alias("s"))
    return e.select("user_id", F.array_join(sampling.keyframes(F.lit(300), 8, F.col("s")), ",").alias("frames"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels))::BIGINT AS known, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS fresh, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark))::BIGINT AS either, (SELECT count(*) = 1 FROM (SELECT DISTINCT lang, source FROM documents)) AS one_signature")
def set_operations(spark, sf):
    d, known, b = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id"), table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    ids = d.select("doc_id")
    parts = ids.intersect(known).agg(F.count("*").alias("known")).crossJoin(ids.subtract(known).agg(F.count("*").alias("fresh"))).crossJoin(ids.union(b).distinct().agg(F.count("*").alias("either")))
    return parts.crossJoin(d.agg((F.countDistinct(F.struct("lang", "source")) == 1).alias("one_signature")))


@query("SELECT doc_id, upper(to_base64(encode(source))) AS b64, md5(text) AS content FROM documents")
def binary_functions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.upper(F.base64(F.col("source").cast("binary"))).alias("b64"), F.md5("text").alias("content"))


@query("SELECT event_id, array_to_string(list_transform(list_filter([event_type, '', props], lambda x: x <> ''), lambda x: x), ' | ') AS line, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'caption' END AS source_text FROM events")
def display_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.concat_ws(" | ", F.filter(F.array("event_type", F.lit(""), "props"), lambda x: x != "")).alias("line"), captions.filled(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" "), F.lit("caption")).alias("source_text"))


# ---- ordered joins, status flows, index tables


@query("""SELECT row_number() OVER (ORDER BY k.pos, o.o_totalprice, o.o_orderkey::VARCHAR) - 1 AS pos, o.o_orderkey AS segment_id, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN (SELECT unnest([71, 4, 128, 13]) AS id, unnest([0, 1, 2, 3]) AS pos) k ON c.c_custkey = k.id""")
def segments_in_order(spark, sf):
    """The orders of some customers, as the segments of some videos: in the order of the list, then of their start."""
    s = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("segment_id"), F.col("o_custkey").alias("video_id"), F.col("o_totalprice").alias("start_time"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("name"))
    rows = tables.segments_of(s, v, [71, 4, 128, 13, 4]).collect()  # those of four videos
    return spark.createDataFrame([(i, int(r.segment_id), r["name"]) for i, r in enumerate(rows)], "pos long, segment_id long, name string")


@query("""SELECT row_number() OVER (ORDER BY k.pos, CASE WHEN o.o_orderkey % 3 = 0 THEN 999999 ELSE o.o_orderkey % 7 END, o.o_orderkey::VARCHAR) - 1 AS pos, o.o_orderkey AS segment_id FROM orders o
 JOIN (SELECT unnest([71, 4, 128, 13]) AS id, unnest([0, 1, 2, 3]) AS pos) k ON o.o_custkey = k.id WHERE o.o_orderkey % 2 = 0""")
def representatives_in_order(spark, sf):
    key = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(key.cast("string").alias("segment_id"), F.col("o_custkey").alias("video_id"), F.when(key % 2 == 0, 1).alias("is_representative"), F.when(key % 3 != 0, (key % 7).cast("int")).alias("representative_rank"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("name"))
    rows = tables.segments_of(s, v, [71, 4, 128, 13], representative=True).collect()
    return spark.createDataFrame([(i, int(r.segment_id)) for i, r in enumerate(rows)], "pos long, segment_id long")


@query("""SELECT md5(string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY o_custkey, l_shipdate, l_linenumber, l_orderkey)) AS order_md5, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (7, 8, 10)""")
def frames_in_order(spark, sf):
    """The lines of some customers, as the frames of some videos, in the order of video, time and frame."""
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_shipdate").alias("ts"), (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_orderkey")).alias("frame_index"), "l_linenumber")
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("video_id"))
    v = table(spark, sf, "customer").filter("c_custkey in (7, 8, 10)").select(F.col("c_custkey").alias("video_id"))
    line = ",".join(f"{r.segment_id}:{r.l_linenumber}" for r in tables.ordered_frames(f, s, v).collect())  # those of three videos
    return spark.createDataFrame([(line, line.count(":"))], "line string, n long").select(F.md5("line").alias("order_md5"), "n")


STATES = "['pending', 'captioning', 'caption_done', 'done', 'failed']"


@query(f"""SELECT s_suppkey, coalesce(st NOT IN ('done', 'caption_done', 'failed'), true) AS plain, coalesce(st NOT IN ('done', 'caption_done'), true) AS retried, true AS forced FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 < 5 THEN ({STATES})[s_suppkey % 6 + 1] END AS st FROM supplier)""")
def should_caption(spark, sf):
    status = F.get(F.array(*[F.lit(x) for x in ("pending", "captioning", "caption_done", "done", "failed")]), (F.col("s_suppkey") % 6).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", tables.should_caption(status).alias("plain"), tables.should_caption(status, retry_failed=True).alias("retried"), tables.should_caption(status, force=True).alias("forced"))


@query("""SELECT s_suppkey AS image_id, CASE WHEN s_suppkey % 4 = 0 THEN 'failed' WHEN s_suppkey % 4 = 1 THEN 'captioning' ELSE 'done' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'down' WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'old' END AS error_message, s_name AS caption FROM supplier""")
def image_status_flow(spark, sf):
    images = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit("done").alias("status"), F.lit("old").alias("error_message"), F.col("s_name").alias("caption"))
    started = tables.mark_captioning(images, images.filter("image_id % 4 = 1"))
    failures = images.filter("image_id % 4 = 0").select("image_id", F.lit("down").alias("error")).unionAll(spark.createDataFrame([(-1, "unknown")], "image_id long, error string"))
    return tables.mark_failed(started, failures)


@query("""SELECT c_custkey AS video_id, CASE c_custkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'old' END AS status, CASE WHEN c_custkey % 5 = 2 THEN 'why' WHEN c_custkey % 5 = 4 THEN 'before' END AS error_message FROM customer""")
def video_lifecycle(spark, sf):
    videos = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.lit("old").alias("status"), F.lit("before").alias("error_message"))
    event = F.get(F.array(*[F.lit(x) for x in ("start", "complete", "fail", "reset")]), (F.col("video_id") % 5).cast("int"))
    return tables.mark_videos(videos, videos.select("video_id", event.alias("event"), F.lit("why").alias("error")).filter("event is not null"))


@query("""SELECT count(*) FILTER (WHERE ok)::BIGINT AS synced, count(*) FILTER (WHERE NOT ok)::BIGINT AS skipped, max(n)::BIGINT AS n_rows, sum(len(d)) FILTER (WHERE ok)::BIGINT AS described FROM (SELECT doc_id % 3 <> 0 AND trim(text) <> '' AS ok, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> '') AS n, source AS d FROM documents)""")
def sync_records(spark, sf):
    d = table(spark, sf, "documents")
    records = d.select(F.col("doc_id").alias("video_id"), F.when(F.col("doc_id") % 3 != 0, "ok").otherwise("error").alias("status"), F.when(F.trim("text") != "", F.col("source")).otherwise("").alias("description"), F.array("lang").alias("tags"))
    out, counts = tables.sync_records(records.limit(0), records, tables.MergeSpec(("video_id",), ("description", "tags")))
    return counts.crossJoin(out.agg(F.count("*").alias("n_rows"), F.sum(F.char_length("description")).alias("described")))


@query("SELECT (SELECT count(*) FROM embeddings)::BIGINT AS vectors_frame, (SELECT count(DISTINCT segment_id) FROM f)::BIGINT AS vectors_segment, (SELECT sum(least(n, 8)) FROM (SELECT count(DISTINCT segment_id) AS n FROM f GROUP BY video_id))::BIGINT AS vectors_video FROM (SELECT 1)".replace("SELECT (SELECT", "WITH " + FRAMES.replace("frames AS", "f AS") + " SELECT (SELECT", 1))
def index_tables(spark, sf):
    f = frames(spark, sf)
    segments = materialise(engines.build_segments(f), "segments")
    refreshed = engines.refresh_representatives(segments.withColumnRenamed("rank", "old_rank") if "rank" in segments.columns else segments)
    own = engines.index_tables(f, refreshed)
    out = None
    for name, index in own.items():
        one = index.agg(F.countDistinct("item_id").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@query("SELECT event_id, round_even(event_id / 29.97::DOUBLE, 3) AS ts, greatest(1, floor((event_id % 2000 + 1) * least(1.0, 640.0 / greatest(event_id % 2000 + 1, 480))))::INT AS width FROM events")
def frame_times(spark, sf):
    side = (F.col("event_id") % 2000 + 1).cast("int")
    return table(spark, sf, "events").select("event_id", sampling.frame_time("event_id", 29.97).alias("ts"), sampling.fit_within(side, F.lit(480), 640, cut=True)["width"].alias("width"))


@query("SELECT page_id, substr(p, 12) AS path, p AS note FROM (SELECT page_id, '/srv/media/' || regexp_replace(url, '^https?://[^/]*/', '') AS p FROM pages)")
def portable_records(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/srv/media/"), F.regexp_replace("url", "^https?://[^/]*/", "")).alias("path"))
    return paths.portable_records(p.withColumn("note", F.col("path")), "/srv/media")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS n, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0)::BIGINT AS records_encoded, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0 AND trim(text) <> '')::BIGINT AS n_new, 'full' AS last_build_mode")
def refresh_documents(spark, sf):
    """Documents of which each fifth has no vector, or one older than its text, brought up to date."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(i % 10 != 0, F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"), F.lit("2024-01-02").alias("caption_updated_at"), F.when(i % 10 == 5, "2024-01-01").otherwise("2024-01-03").alias("embedding_updated_at"))
    out, built = engines.refresh_documents(d, HashEncoder(), F.col("text"))
    counts = out.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("n_new"))
    return counts.crossJoin(built.select("records_encoded", "last_build_mode"))


# ---- files and records: what is written to the application's folder is read again


def folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type AS label, round(value, 6) AS value FROM events")
def jsonl_round_trip(spark, sf):
    """JSON lines appended in two parts, with blank lines and a line that is no object among them."""
    e, path = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"), "value"), folder(spark, "lines")
    files.append_jsonl(e.filter("event_id % 2 = 0"), path)
    files.append_jsonl(e.filter("event_id % 2 = 1"), path)
    spark.createDataFrame([("",), ("  ",), ("[1, 2]",), ("7",)], "value string").write.mode("append").text(path)
    return files.read_jsonl(spark, path, e.schema).select("event_id", "label", r6("value").alias("value"))


def caption_log(spark, sf) -> str:
    """A caption log of the events: aliases, failed, untagged and empty records, and some broken lines on request."""
    i, path = F.col("event_id"), folder(spark, "captions")
    record = F.struct(
        F.when(i % 2 == 0, i.cast("string")).alias("video_id"), F.when(i % 2 == 1, i.cast("string")).alias("videoID"), F.when(i % 5 == 0, "error").otherwise("ok").alias("status"),
        F.when(i % 7 != 0, F.col("event_type")).alias("description"), F.when(i % 3 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    table(spark, sf, "events").select(F.to_json(record).alias("value")).write.text(path)
    return path


@query("SELECT event_id, event_type AS description, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_tags FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def caption_records(spark, sf):
    r = files.caption_records(spark, caption_log(spark, sf))
    return r.select(F.col("video_id").cast("long").alias("event_id"), "description", F.size("tags").cast("long").alias("n_tags"))


@query("SELECT (SELECT count(*) FROM events WHERE event_id % 7 <> 0)::BIGINT AS with_failed, (SELECT count(*) FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 = 0)::BIGINT AS structured")
def caption_record_counts(spark, sf):
    path = caption_log(spark, sf)
    a = files.caption_records(spark, path, include_failed=True).agg(F.count("*").alias("with_failed"))
    return a.crossJoin(files.caption_records(spark, path, structured_only=True).agg(F.count("*").alias("structured")))  # one row each


@query("SELECT user_id, max(event_id) AS last, count(*) FILTER (WHERE event_id >= 0) > 0 AS there FROM events GROUP BY 1")
def resume_log(spark, sf):
    """A log with broken lines: of each user the record that comes last in it."""
    path = folder(spark, "resume")
    e = table(spark, sf, "events").orderBy("event_id").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").cast("string").alias("caption"))).alias("value"))
    # one file, so that the lines have an order
    e.unionAll(spark.createDataFrame([("{broken",), ("",)], "value string")).coalesce(1).write.text(path)
    return files.resume_records(spark, path).select(F.col("video_id").cast("long").alias("user_id"), F.col("caption").cast("long").alias("last"), F.lit(True).alias("there"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, round(list_sum(embedding::DOUBLE[]), 5) AS total, vec_id % 9 <> 0 AS sized FROM embeddings")
def vector_blobs(spark, sf):
    """Vectors as float32 blobs and back; a blob of another size than its dim says is no vector."""
    e = table(spark, sf, "embeddings").withColumn("blob", files.encode_floats("embedding")).withColumn("dim", F.when(F.col("vec_id") % 9 == 0, 63).otherwise(64))
    e = e.withColumns({"back": files.decode_floats("blob", F.lit(64)), "sized": files.decode_floats("blob", "dim").isNotNull()})
    return e.select("vec_id", F.element_at("back", 1).cast("double").alias("first"), F.round(F.aggregate("back", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "sized")


@query("SELECT label::BIGINT AS label, count(*)::BIGINT AS n, 'clip' AS index_kind FROM embeddings GROUP BY 1")
def vector_index_round_trip(spark, sf):
    path = folder(spark, "index")
    files.write_vectors(items(spark, sf), path, kind="clip", model="m")
    return files.read_vectors(spark, path, "clip").groupBy("label", "index_kind").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) AS caption, arg_max(round(value, 6)::VARCHAR, CASE WHEN event_id % 4 <> 0 THEN event_id END) AS model FROM events GROUP BY 1")
def caption_ingest(spark, sf):
    """Records streamed in three files, a micro-batch each, merged into a table: the last caption, the last model that is given."""
    source, target = folder(spark, "arriving"), folder(spark, "ingested")
    e = table(spark, sf, "events").orderBy("event_id")
    rows = e.select("event_id", F.struct(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("caption"), F.when(F.col("event_id") % 4 != 0, F.round("value", 6).cast("string")).alias("model")).alias("r"))
    first, second = e.agg(F.percentile_approx("event_id", [1 / 3, 2 / 3])).first()[0]
    for own in (F.col("event_id") <= first, (F.col("event_id") > first) & (F.col("event_id") <= second), F.col("event_id") > second):
        rows.filter(own).orderBy("event_id").select("r.*").coalesce(1).write.mode("append").json(source)
        ingest.ingest_captions(ingest.caption_stream(spark, source), target, f"{target}-checkpoint").awaitTermination()
    return ingest.current(spark, target).select(F.col("video_id").cast("long").alias("user_id"), "caption", "model")


@query("SELECT n, k, CASE WHEN n <= k THEN n ELSE k END::BIGINT AS kept, 0::BIGINT AS first, ((n - 1) * 3)::BIGINT AS last FROM (SELECT unnest([5, 9, 40]) AS n), (SELECT unnest([2, 7, 10]) AS k)")
def downsample_frames(spark, sf):
    d = spark.createDataFrame([(n, k) for n in (5, 9, 40) for k in (2, 7, 10)], "n int, k int")
    own = sampling.downsample(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i * 3), "k")
    d = d.withColumn("own", own)
    return d.select("n", "k", F.size("own").cast("long").alias("kept"), F.element_at("own", 1).cast("long").alias("first"), F.element_at("own", -1).cast("long").alias("last"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type END AS answer, printf('%.1f-%.1f s (%.3f) · 9.0-9.5 s (0.125)', (event_id % 50)::DOUBLE, (event_id % 50 + 1)::DOUBLE, (event_id % 8) / 8.0) AS intervals, 'text|p|image_url|data:image/jpeg;base64,' || to_base64(encode(event_type)) AS message FROM events""")
def response_texts(spark, sf):
    """Answers of models in their shapes, intervals as text, and the parts of a captioning request."""
    t, i = F.col("event_type"), F.col("event_id")
    chat = F.concat(F.lit('{"choices":[{"message":{"content":"'), t, F.lit(' "}}]}'))
    parts = F.concat(F.lit('{"choices":[{"message":{"content":[{"text":" '), t, F.lit('"},{"text":""}]}}]}'))
    output = F.concat(F.lit('{"output":[{"content":[{"text":"'), t, F.lit('"}]}]}'))
    answer = F.when(i % 4 == 0, chat).when(i % 4 == 1, parts).when(i % 4 == 2, output).otherwise("{}")
    span = lambda a, b, s: F.struct(a.alias("start"), b.alias("end"), s.alias("score"))
    spans = F.array(span((i % 50).cast("double"), (i % 50 + 1).cast("double"), (i % 8) / 8.0), span(F.lit(9.0), F.lit(9.5), F.lit(0.125)))
    message = F.array_join(F.flatten(F.transform(captions.prompt_messages(F.lit("p"), F.array(t.cast("binary"))), lambda m: F.array(m["type"], m["value"]))), "|")
    return table(spark, sf, "events").select("event_id", captions.response_text(answer).alias("answer"), captions.format_intervals(spans).alias("intervals"), message.alias("message"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || p_partkey WHEN 1 THEN '/root/pictures/' || p_name || p_partkey WHEN 2 THEN '/root/pictures/' || p_partkey || '.png' END AS resolved FROM part""")
def image_files(spark, sf):
    """Image paths that are found as they are, below the root, by their item's name, or not at all."""
    p, name = F.col("p_partkey"), F.concat("p_name", F.col("p_partkey").cast("string"))
    rows = table(spark, sf, "part").select(p.cast("string").alias("item_id"), name.alias("path"), p)
    here = F.when(p % 4 == 0, name).when(p % 4 == 1, F.concat(F.lit("/root/pictures/"), name)).when(p % 4 == 2, F.concat(F.lit("/root/pictures/"), p.cast("string"), F.lit(".png")))
    known = table(spark, sf, "part").select(here.alias("path")).filter("path is not null")
    own = rows.withColumn("path", F.when(F.col("p_partkey") % 4 < 2, F.col("path")).otherwise(F.concat(F.lit("gone/"), F.col("item_id"))))
    return paths.resolve_files(own.select("item_id", "path"), known, ["/root/pictures"]).select(F.col("item_id").cast("long").alias("p_partkey"), F.col("resolved_path").alias("resolved"))
