"""Column functions against hand-made values, and BM25 against SQLite's FTS5."""

import math
import sqlite3
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequarry.config import HybridConfig, RetrievalConfig, fetch_k, validate_request
from framequarry.functions import batches, captions, paths, sampling
from framequarry.functions import text as X
from framequarry.operators import bm25


def values(spark, expr, rows, name="x", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    got = values(spark, X.tokens("x"), ["红色连衣裙", "iPhone15手机", "été", "橘猫 沙发", "红", "a_B a b", None, "ＡＢＣ", "连衣裙"])
    assert got == [["红色", "色连", "连衣", "衣裙", "红色连", "色连衣", "连衣裙"], ["iphone15", "手机"], ["t"], ["橘猫", "沙发"], ["红"], ["a", "b"], [], [], ["连衣裙", "连衣", "衣裙"]]
    assert values(spark, X.normalize_text("x", nfkc=True), ["ＡＢＣ  ｄ\u3000é"]) == ["ABC d é"]
    assert values(spark, X.tag_terms("x"), [["Red Cat", "cat", " "]], kind="array<string>") == [["red cat", "red", "cat"]]
    assert values(spark, X.query_terms("x"), ["Привет мир", "😀", "  ", " ".join(f"w{i}" for i in range(30))]) == [["привет мир"], ["😀"], [], [f"w{i}" for i in range(24)]]
    assert values(spark, X.caption_terms(F.col("x"), F.lit("big cat"), F.lit("dog")), [["Red Cat"]], kind="array<string>") == [["red cat", "big", "cat", "dog"]]


def test_bm25_equals_fts5(spark):
    docs = [("v1", "cat dog", "x y z", "cat"), ("v2", "bird", "cat x", "y q w"), ("v3", "fish", "y", "cat cat z"), ("v4", "m n", "o p", "q r s"), ("v5", "k", "l", "m n o")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(video_id UNINDEXED, tags, description, caption, tokenize=\"unicode61 remove_diacritics 0\")")
    con.executemany("INSERT INTO t VALUES (?,?,?,?)", docs)
    df = spark.createDataFrame(docs, "video_id string, tags_terms string, description_terms string, caption_terms string")
    index = bm25.build(df, "video_id")
    for text in ("cat", "cat x q", "k", "none"):
        want = dict(con.execute("SELECT video_id, bm25(t, 5.0, 2.0, 1.0) FROM t WHERE t MATCH ?", (" OR ".join(f'"{w}"' for w in text.split()),)).fetchall())
        q = spark.createDataFrame([(0, text)], "query_id int, text string")
        got = {r.video_id: r.sparse_score for r in bm25.search(index, bm25.query_rows(q, "text")).collect()}
        assert got == pytest.approx(want)


def test_bm25_sum_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    terms = [f"t{i}" for i in range(9)]
    df = {t: 150 + 37 * i for i, t in enumerate(terms)}  # documents of one term besides the 100 that have all
    rows = [(d, t, 2.0, 57) for d in range(100) for t in rng.permutation(terms).tolist()] + [(1000 * (i + 1) + d, t, 1.0, 57) for i, t in enumerate(terms) for d in range(df[t])]
    spark.createDataFrame(rows, "id long, term string, f double, length long").coalesce(1).write.parquet(f"{tmp_path}/postings")
    index = bm25.SparseIndex("id", spark.read.parquet(f"{tmp_path}/postings"), spark.createDataFrame([(9000, 61.3)], "n_docs long, avg_length double"))
    scores = {r.id: r.sparse_score for r in bm25.search(index, spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")).collect()}
    idf = [math.log((9000 - n - 100 + 0.5) / (n + 100 + 0.5)) for n in df.values()]
    assert len({scores[d] for d in range(100)}) == 1
    assert scores[0] == pytest.approx(-sum(x * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 57 / 61.3)) for x in idf), rel=1e-14)


def peak(run, batch):
    """MB that Python and numpy hold at most while ``run`` works off one Arrow batch."""
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_index_is_made_of_a_few_documents_at_a_time(spark, monkeypatch):
    caught = []
    df = spark.createDataFrame([(0, ["a"], "b", "c")], "id long, tags array<string>, d string, c string")
    fields = spark.createDataFrame([(0, "a", "b", "c")], "id long, tags_terms string, description_terms string, caption_terms string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f) or spark.createDataFrame([], schema))
    monkeypatch.setattr(bm25, "materialise", lambda df, name: df)
    bm25.term_fields(df, "id", F.col("tags"), F.col("d"), F.col("c"))
    bm25.build(fields, "id")
    texts = [" ".join(f"w{i * 7 + j}" for j in range(200)) for i in range(3000)]
    wide = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([["a"]] * 3000), pa.array(texts), pa.array([None] * 3000, pa.string())], names=["id", "tags", "d", "c"])
    assert peak(caught[0], wide) < 20
    narrow = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["a"] * 3000), pa.array(texts), pa.array(texts)], names=["id", "t", "d", "c"])
    assert peak(caught[1], narrow) < 30


def test_lots():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1003)), pa.array([None, "x" * (batches.LOT_BYTES + 5), *["é" * 9] * 1001])], names=["i", "t"])
    got = list(batches.lots([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch])
    assert [x.num_rows for x in got] == [1, 1, 256, 256, 256, 233]
    assert [x.num_rows for x in batches.lots([batch.select(["i"])])] == [256, 256, 256, 235]


def test_captions(spark):
    assert values(spark, captions.normalize_tags("x"), ['["a", " b", "a"]', '{"tags": ["c"]}', "a，b; c、a|d\ne", None, "{broken", '{"tags": "x, y"}']) == [["a", "b"], ["c"], ["a", "b", "c", "d", "e"], [], ["{broken"], ["x", "y"]]
    assert values(spark, captions.normalize_tags("x", parse_json=False), ['["a"]']) == [['["a"]']]
    answers = ['```json\n{"tags": ["a"], "description": "d"}\n```', '{"标签": ["甲"], "描述": "乙"}', "no json", '{"tags": [], "description": "d"}', '{"tags": ["a"]}', "x {bad} y"]
    got = values(spark, captions.parse_video_caption("x"), answers)
    assert [(g.tags, g.description, g.error) for g in got] == [(["a"], "d", None), (["甲"], "乙", None), ([], None, "invalid json"), ([], "d", "no tags"), (["a"], None, "no description"), ([], None, "invalid json")]
    image = values(spark, captions.parse_image_caption("x"), ['{"subject": "cat", "颜色": "red"}', "just text", '{"color": "red"}'])
    assert [tuple(g) for g in image] == [("cat", "red", "", "", ""), ("", "", "", "", "just text"), ("", "", "", "", '{"color": "red"}')]
    line = captions.embedding_text(F.col("x"), F.lit("red"), F.lit(""), F.lit(None), F.lit("d"))
    assert values(spark, line, ["cat"]) == ["主体: [cat] | 颜色: [red] | 动作: [-] | 风格: [-] 描述: d"]
    assert values(spark, captions.video_index("x"), ["clip_0042", "7a", "12"]) == [42, None, 12]
    intervals = F.array(*[F.struct(F.lit(1.0).alias("start"), F.lit(2.5).alias("end"), F.lit(0.5).alias("score"))] * 4)
    assert values(spark, captions.format_intervals(intervals), ["x"]) == [" · ".join(["1.0-2.5 s (0.500)"] * 3)]


def test_records_by_any_alias(spark):
    df = spark.createDataFrame([("v1", "p", "a,b", None, "cap", "x1.5"), (" ", "p", None, None, None, "2")], "videoID string, path string, captionTags string, description string, caption string, duration string")
    a, b = captions.normalize_records(df).collect()
    assert (a.video_id, a.tags, a.description, a.caption, a.status, a.duration_seconds) == ("v1", ["a", "b"], "cap", "cap", "ok", None)
    assert b.video_id is None and b.status == "missing" and b.duration_seconds == 2.0


def test_paths(spark):
    assert values(spark, paths.stem("x"), ["/a/b.c.mp4", "C:\\v\\x.mov", ".env", "n"]) == ["b.c", "x", ".env", "n"]
    got = values(spark, paths.split_item("x"), ["a::b::c", "a"])
    assert [tuple(g) for g in got] == [("a", "b::c"), ("a", "")]
    assert values(spark, paths.resolve_portable("x", "/srv/media"), ["a/b.jpg", "/srv/media/c", "D:\\media\\x\\media\\y.jpg", "/other/z", ""]) == ["/srv/media/a/b.jpg", "/srv/media/c", "/srv/media/y.jpg", "/other/z", "/srv/media"]
    assert values(spark, paths.image_id("x", "/srv/media"), ["/srv/media/a.b/c.jpg", "/srv/media/d"]) == ["a.b/c", "d"]
    assert values(spark, paths.embedding_name("x"), ["a/b\\c"]) == ["a__b__c.npy"]
    items = spark.createDataFrame([("a", "x/a.gif"), ("b", None), ("c", "c.jpg")], "item_id string, path string")
    files = spark.createDataFrame([("/r/x/a.gif",), ("/r/b.png",), ("/r/b.jpeg",)], "path string")
    assert {r.item_id: r.resolved_path for r in paths.resolve_files(items, files, ["/r"]).collect()} == {"a": "/r/x/a.gif", "b": "/r/b.jpeg", "c": None}


def test_sampling(spark):
    rows = spark.createDataFrame([(10, 4), (3, 5), (1, 1), (0, 3), (7, 1), (100, 8)], "n int, k int")
    got = [r.v for r in rows.select(sampling.uniform_indices("n", "k").alias("v")).collect()]
    assert got == [[0, 3, 6, 9], [0, 1, 2], [0], [], [0], [0, 14, 28, 42, 57, 71, 85, 99]]
    assert values(spark, sampling.downsample("x", 3), [[5, 1, 1, 9, 7, 3], [2, 1]], kind="array<int>") == [[1, 5, 9], [1, 2]]
    assert values(spark, sampling.keyframes(100, 4, "x"), [[], [10, 20, 30], [50]], kind="array<int>") == [[0, 33, 66, 99], [0, 10, 30, 99], [0, 33, 66, 99]]
    assert values(spark, sampling.multi_frame("x"), [0, 2, 3, 9], kind="int") == [[], [0, 1], [0, 1, 2], [0, 4, 8]]
    assert [tuple(v) for v in values(spark, sampling.fit_within("x", F.lit(100), 50), [200, 40], kind="int")] == [(50, 25), (20, 50)]
    assert values(spark, sampling.keep_frame("x", F.lit(200), F.lit(100), 30, 2, 100), [0, 15, 16], kind="int") == [True, True, False]


def test_parameters():
    assert (fetch_k(10, 1000), fetch_k(10, 30), fetch_k(0, 5)) == (50, 30, 0)
    assert HybridConfig().limits(200) == (200, 200, 60) and HybridConfig().limits(5, 7, 9, 1) == (7, 9, 1)
    assert RetrievalConfig().override(video_recall=3, merge_gap=None).video_recall == 3
    for bad in (dict(query=""), dict(query="a", top_k=0), dict(query="a", rrf_k=501)):
        with pytest.raises(ValueError):
            validate_request(**bad)
    with pytest.raises(ValueError):
        RetrievalConfig().override(nothing=1)
