"""Operators against plain numpy and hand-made tables."""

import json
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.config import IndexConfig
from framequarry.operators import fusion, greedy, pooling, tables, temporal, topk
from framequarry.plans import encoders, engines
from framequarry.sources import files
from framequarry.streaming import ingest


def vectors(spark, v, **more):
    rows = [(i, [float(x) for x in row], *[m[i] for m in more.values()]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, ["item_id", "embedding", *more])


def unit(rng, n, d=6):
    v = rng.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_topk_blocks_ties_and_nulls(spark):
    rng = np.random.default_rng(0)
    v = np.round(unit(rng, 300), 1)
    index = vectors(spark, v).union(spark.createDataFrame([(999, None)], "item_id long, embedding array<double>")).repartition(5)
    queries = vectors(spark, v[:7]).withColumnRenamed("item_id", "query_id")
    for block in (2, 100):
        got = {(r.query_id, r["rank"]): r.item_id for r in topk.inner_product_topk(index, queries, 9, block=block).collect()}
        for q in range(7):
            order = sorted(range(300), key=lambda i: (-float(v[q] @ v[i]), i))
            scores = [float(v[q] @ v[i]) for i in order]
            for r in range(9):
                assert got[q, r + 1] == order[r] or math.isclose(float(v[q] @ v[got[q, r + 1]]), scores[r], abs_tol=1e-12)
    assert topk.inner_product_topk(index, queries.limit(0), 3).count() == 0
    assert [r.item_id for r in topk.in_order(index, "item_id", [5, 2, 5, 9]).collect()] == [5, 2, 9]


def test_equal_vectors_have_equal_scores_in_any_place(spark):
    rng = np.random.default_rng(3)
    v, q = unit(rng, 1, 64)[0], unit(rng, 1, 64)[0]
    index = vectors(spark, [v] * 1003).coalesce(1)
    queries = vectors(spark, [q]).withColumnRenamed("item_id", "query_id")
    got = topk.inner_product_topk(index, queries, 1003).orderBy("rank").collect()
    assert [r.item_id for r in got] == list(range(1003))
    assert {r.score for r in got} == {float(np.cumsum(v * q)[-1])}


def test_genericness_and_diversity_equal_pairs(spark):
    v = unit(np.random.default_rng(1), 40)
    df = vectors(spark, v, g=[i % 3 for i in range(39)] + [9])
    s = v @ v.T
    np.fill_diagonal(s, 0)
    got = {r.item_id: r.genericness for r in pooling.genericness(df, "item_id", "embedding").collect()}
    assert np.allclose([got[i] for i in range(40)], s.mean(axis=1))
    for r in pooling.diversity(df, ["g"], "embedding").collect():
        own = [i for i in range(39) if i % 3 == r.g]
        pairs = [1 - float(v[a] @ v[b]) for a in own for b in own if a < b] if r.g != 9 else []
        assert r.diversity == pytest.approx(np.mean(pairs) if pairs else 0.0)


def test_consensus(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.9), ("b", 0.3), ("b", 0.05), ("c", -0.2), ("c", -0.4)], "k string, s double")
    got = {r.k: r.consensus for r in pooling.consensus_top_k(df, ["k"], "s", 3).collect()}

    def want(values):
        kept = sorted(values, reverse=True)[:3]
        if len(kept) == 1:
            return kept[0]
        x = np.array(kept)
        smooth = x.max() + (np.log(np.exp((x - x.max()) * 10).sum()) - np.log(len(x))) / 10
        ratio = np.mean(x >= 0.18)
        return 0.65 * smooth + 0.35 * x.mean() + 0.08 * ratio * kept[-1] - 0.06 * max(0, kept[0] - x.mean()) * (1 - ratio)

    assert got == pytest.approx({"a": 0.5, "b": want([0.1, 0.9, 0.3, 0.05]), "c": want([-0.2, -0.4])})


def test_representatives_and_suppression_equal_loops(spark):
    rng = np.random.default_rng(2)
    v, imp, gen = unit(rng, 30), rng.random(30), rng.random(30)
    df = vectors(spark, v, video=[i % 2 for i in range(30)], imp=imp.tolist(), gen=gen.tolist())
    got = {(r.video, r["rank"]): r.item_id for r in greedy.representatives(df, ["video"], "item_id", "imp", "gen", "embedding", IndexConfig(representatives=6)).collect()}
    for video in (0, 1):
        left, taken = [i for i in range(30) if i % 2 == video], []
        while len(taken) < 6:
            score = lambda i: imp[i] - 0.35 * gen[i] - 0.25 * max((float(v[i] @ v[j]) for j in taken), default=0.0)
            best = max(left, key=lambda i: (score(i), -i))
            left.remove(best)
            taken.append(best)
        assert [got[video, r + 1] for r in range(6)] == taken
    hits = df.withColumn("score", F.col("imp"))
    kept = [r.item_id for r in greedy.suppress_near(hits, ["video"], "item_id", "score", "embedding", 0.4, 5).filter("video = 0").orderBy("rank").collect()]
    want = []
    for i in sorted((i for i in range(30) if i % 2 == 0), key=lambda i: -imp[i]):
        if len(want) < 5 and all(float(v[i] @ v[j]) < 0.4 for j in want):
            want.append(i)
    assert kept == want


def test_frame_selection(spark):
    same = [[1.0, 0.0]] * 4 + [[0.0, 1.0]]
    df = vectors(spark, same, seg=["s"] * 5, norm=[1.0, 3.0, 2.0, 1.0, 0.5], ts=[0.0, 0.5, 1.0, 1.5, 2.0])
    got = [(r.item_id, r["rank"]) for r in greedy.select_frames(df, ["seg"], "item_id", "embedding", "norm", "ts").orderBy("rank").collect()]
    assert got == [(1, 1), (4, 2)]
    own, _ = greedy.cluster(np.eye(3), np.ones(3), 3, 12)
    assert sorted(own.tolist()) == [0, 1, 2]


def test_scene_changes(spark):
    df = spark.createDataFrame([(0, [[0.0], [0.1], [0.5], [0.55], [1.2], [0.5]])], "i int, s array<array<double>>")
    sigs = F.transform("s", lambda x, i: F.struct(i.alias("idx"), x.alias("sig")))
    assert df.select(greedy.scene_changes(sigs, 0.3, 2).alias("v")).first().v == [0, 2, 4, 5]


def test_islands_partition_hits(spark):
    rng = np.random.default_rng(3)
    v = unit(rng, 50, 2)
    df = vectors(spark, v, video=[i % 3 for i in range(50)], ts=[float(x) for x in np.cumsum(rng.random(50))])
    rows = temporal.islands(df, ["video"], "ts", 1.5, "item_id", "embedding", 0.0).collect()
    assert len(rows) == 50
    for video in range(3):
        own = sorted((r for r in rows if r.video == video), key=lambda r: r.ts)
        for a, b in zip(own, own[1:], strict=False):
            joined = b.ts - a.ts <= 1.5 and float(v[a.item_id] @ v[b.item_id]) >= 0
            assert (a.island == b.island) == joined and (b.similarity is not None) == joined


def test_fusion_ties_and_federation(spark):
    sparse = spark.createDataFrame([("a", 1, -3.0), ("b", 2, -2.0)], "video_id string, sparse_rank int, sparse_score double")
    dense = spark.createDataFrame([("b", 2, 0.5), ("c", 1, 0.0)], "video_id string, dense_rank int, dense_score double")
    got = [(r.video_id, round(r.score, 9)) for r in fusion.rrf_fuse(sparse, dense).orderBy(*fusion.fused_order()).collect()]
    assert got == [("b", round(2 / 62, 9)), ("c", round(1 / 61, 9)), ("a", round(1 / 61, 9))]
    one = spark.createDataFrame([("a", 1.0, "", ["x"])], "video_id string, score double, description string, tags array<string>")
    two = spark.createDataFrame([("a", 0.5, "d", []), ("b", 0.2, None, None)], "video_id string, score double, description string, tags array<string>")
    a, b = fusion.federate([("p", one), ("q", two)]).orderBy("video_id").collect()
    assert (a.score, a.description, a.tags, a.sources, a.source_profile) == (1.5, "d", ["x"], ["p", "q"], "p") and b.description is None


def test_merge_equals_row_by_row_upserts(spark):
    spec = tables.MergeSpec(("k",), ("a",), ("b",))
    old = {1: ("x", "y"), 2: ("p", None)}
    changes = [(1, None, None), (3, "n", "m"), (2, "q", "r"), (2, "s", None), (3, None, None)]
    target = spark.createDataFrame([(k, *v) for k, v in old.items()], "k int, a string, b string")
    source = spark.createDataFrame([(*c, i) for i, c in enumerate(changes)], "k int, a string, b string, o int")
    for k, a, b in changes:
        old[k] = (a, b if b is not None else old.get(k, (None, None))[1])
    once = tables.merge(target, source, spec, order="o")
    assert {r.k: (r.a, r.b) for r in once.collect()} == old
    assert {r.k: (r.a, r.b) for r in tables.merge(once, source, spec, order="o").collect()} == old
    keep = tables.merge(target, source, tables.MergeSpec(("k",), ("a", "b"), update=False), order="o")
    assert {r.k: r.a for r in keep.collect()} == {1: "x", 2: "p", 3: "n"}
    only = tables.merge(target, source, tables.MergeSpec(("k",), ("a",), insert=False), order="o")
    assert {r.k for r in only.collect()} == {1, 2}


def test_tables_of_tasks_and_segments(spark):
    tasks = tables.ensure_tasks(spark.createDataFrame([("v:segment", "v", "segment", "failed", 2, 2, "e")], "task_id string, video_id string, stage string, status string, max_retry int, retry_count int, error_message string"), spark.createDataFrame([("v",), ("w",)], "video_id string"))
    assert tasks.count() == 8
    assert {r.a for r in tasks.filter("task_id = 'v:segment'").select(tables.task_action().alias("a")).collect()} == {"raise"}
    reset = tables.reset_tasks(tasks, ["v"], "segment")
    assert reset.filter("video_id = 'v' and status = 'pending' and error_message is null").count() == 4 and reset.filter("task_id = 'v:segment'").first().retry_count == 2
    assert {r.video_id: r.status for r in tables.video_state(tasks).collect()} == {"v": "failed", "w": "pending"}
    seg = spark.createDataFrame([("v", "s1", 7, 1), ("v", "s2", None, 0), ("w", "s3", 1, 1)], "video_id string, segment_id string, representative_rank int, is_representative int")
    flagged = tables.flag_representatives(seg, spark.createDataFrame([("v", "s2", 1)], "video_id string, segment_id string, rank int"))
    assert {(r.segment_id, r.representative_rank, r.is_representative) for r in flagged.collect()} == {("s1", None, 0), ("s2", 1, 1), ("s3", 1, 1)}
    records = spark.createDataFrame([("d", ["t"]), ("", ["t"])], "description string, tags array<string>")
    with pytest.raises(ValueError, match="1 legacy"):
        tables.require_structured(records, "description", "tags")
    like = spark.createDataFrame([("ABC",), ("É",), ("axb",), ("a\\b",)], "x string")
    found = lambda v: [r.x for r in like.filter(tables.contains_ascii("x", v)).collect()]
    assert found("b") == ["ABC", "axb", "a\\b"] and found("é") == [] and found("A_B") == ["axb", "a\\b"] and found("\\") == ["a\\b"]


def test_files_and_captions(spark, tmp_path):
    for name in ("b/x_f000012.JPG", "a.mp4", "c.txt", "a.png"):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(b"123")
    assert [r.path.rpartition("/m/")[2] for r in files.images(spark, str(tmp_path / "m")).collect()] == ["a.png", "b/x_f000012.JPG"]
    assert files.videos(spark, str(tmp_path / "m"), content=True).first().content == b"123"
    assert files.frames_in_folder(spark, str(tmp_path / "m")).first().frame_index == 12
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join([json.dumps({"video_id": "v1", "status": "ok", "caption": "one", "tags": ["a", "b"]}), "", "{broken", "[1]", json.dumps({"videoID": "v2", "status": "error"}), json.dumps({"video_id": "v1", "status": "ok", "caption": "two"})]))
    kept = {r.video_id: r.caption for r in files.resume_records(spark, str(log)).collect()}
    assert kept == {"v1": "two", "v2": None}
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(x for x in log.read_text().splitlines() if "broken" not in x))
    got = [(r.video_id, r.tags, r.description) for r in files.caption_records(spark, str(good)).collect()]
    assert got == [("v1", ["a", "b"], "one"), ("v1", [], "two")]
    assert files.caption_records(spark, str(good), structured_only=True).count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.caption_records(spark, str(log)).collect()
    (tmp_path / "p.txt").write_text(" describe \n\n this ")
    assert files.prompt_text(spark, str(tmp_path / "p.txt")).first().prompt == "describe this"
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "item_id int, embedding array<float>")
    files.write_vectors(v, str(tmp_path / "index"), kind="clip")
    assert files.read_vectors(spark, str(tmp_path / "index"), "clip").count() == 2
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "index"), "text")
    blobs = v.withColumn("b", files.encode_floats("embedding")).withColumn("d", F.lit(2)).withColumn("back", files.decode_floats("b", "d"))
    assert [r.back for r in blobs.orderBy("item_id").collect()] == [[1.0, 2.0], None]


def test_caption_stream_merges_batches(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    (src / "1.json").write_text('{"video_id": "v1", "caption": "one", "model": "m"}\nnot json\n')
    args = dict(table=table, checkpoint=str(tmp_path / "cp"))
    ingest.ingest_captions(ingest.caption_stream(spark, str(src)), **args).awaitTermination()
    (src / "2.json").write_text('{"video_id": "v1", "caption": "two"}\n{"video_id": "v2", "caption": "x"}\n')
    ingest.ingest_captions(ingest.caption_stream(spark, str(src)), **args).awaitTermination()
    assert {r.video_id: (r.caption, r.model) for r in ingest.current(spark, table).collect()} == {"v1": ("two", "m"), "v2": ("x", None)}


def test_engines(spark):
    docs = spark.createDataFrame([("v1", ["cat"], "a cat sleeps", "", "p1"), ("v2", ["dog"], "a dog runs", "", "p2"), ("v3", [], "", "", "p3")], "video_id string, tags array<string>, description string, caption string, video_path string")
    engine = engines.HybridEngine(engines.embed_documents(docs, encoders.HashEncoder(), F.col("description")), encoders.HashEncoder())
    first = engine.search("cat sleeps", 2).first()
    assert first.video_id == "v1" and first.sparse_rank == 1 and engine.search("  ", 2).count() == 0
    assert engines.federated_search([("a", engine), ("b", engine)], "cat", 2).first().score == pytest.approx(2 * engine.search("cat", 1).first().score)
    texts = spark.createDataFrame([(t,) for t in ("a cat sleeps", "a dog runs", "the cat is asleep", "dogs run fast", "cats sleeping", "a dog ran")], "description string")
    svd = encoders.SvdEncoder.fit(texts, "description", dim=3)
    v = svd.encode(["a cat sleeps", "cats sleeping", "dogs run fast"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and v[0] @ v[1] > v[0] @ v[2]
    with pytest.raises(ValueError):
        encoders.load_encoder("none")
    images = spark.createDataFrame([(1, "p1", "m", [1.0, 0.0], "Red"), (2, None, "m", [0.9, 0.1], "blue"), (3, "p3", None, [0.0, 1.0], "red"), (4, "p4", None, None, "red")], "image_id int, path string, md5 string, embedding array<double>, color string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    hits = lambda **k: [(r.image_id, r.path) for r in engines.PictureEngine(images, k.pop("dedup", "md5")).search(q, 3, **k).orderBy("rank").collect()]
    assert hits() == [(1, "p1"), (3, "p3")] and hits(filters={"color": "RED"}) == [(1, "p1"), (3, "p3")] and hits(dedup="embedding", threshold=0.999) == [(1, "p1"), (2, "2"), (3, "p3")]

    def describe(row):
        if row["x"] == 1:
            raise RuntimeError("down")
        return "ok"

    rows = encoders.caption_rows(spark.createDataFrame([(0, 0), (1, 1)], "id int, x int"), describe, ["x"], "id", attempts=2).orderBy("id").collect()
    assert [(r.answer, r.error) for r in rows] == [("ok", None), (None, "RuntimeError: down")]


def test_event_queries_read_all_events_of_a_user(spark, tmp_path):
    from framequarry import queries

    rows = [(1, i, float(i % 300 // 3)) for i in range(900)] + [(2, 1000 + i, 0.0 if i < 250 else 90.0) for i in range(300)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in queries.scene_changes(spark, str(tmp_path)).collect():
        got.setdefault(r.user_id, []).append(r.event_id)
    want, last = [], None
    for _, i, v in rows[:900]:
        if last is None or len(want) < 16 and abs(v - last) >= 30:
            want.append(i)
            last = v
    assert {k: sorted(v) for k, v in got.items()} == {1: want, 2: [1000, 1250]}
    frames = {r.user_id: r.frames for r in queries.keyframe_choice(spark, str(tmp_path)).collect()}
    assert frames[1] == "0,3,100,102,198,199,297,299"


def test_texts_are_encoded_a_few_at_a_time(spark):
    texts = [f"clip {i} " * 150 for i in range(3000)]
    tracemalloc.start()
    try:
        got = encoders.HashEncoder().encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
    assert np.array_equal(got[[0, 1500, 2999]], np.vstack([encoders.HashEncoder().encode([texts[i]]) for i in (0, 1500, 2999)]))
    rows = [(0, " \u3000"), (1, None), (2, "x" * 300_000), *[(i, texts[i]) for i in range(3, 700)]]
    out = spark.createDataFrame(rows, "id int, t string").coalesce(1).withColumn("v", encoders.encode_column(F.col("t"), encoders.HashEncoder())).orderBy("id").collect()
    assert [r.v for r in out[:2]] == [None, None]
    assert np.array_equal(np.array([r.v for r in out[2:]]), encoders.HashEncoder().encode([t for _, t in rows[2:]]))
