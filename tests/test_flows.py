"""K-means against a plain version, file formats, bucketed ingest, picture uploads, the command line."""

import json
import sqlite3
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry import __main__ as cli
from framequarry.functions import text as X
from framequarry.functions.vector import vector_sum
from framequarry.operators import greedy
from framequarry.plans import encoders
from framequarry.service import Route, SearchService, serve
from framequarry.session import shared_dir
from framequarry.sources import files
from framequarry.streaming import ingest


def plain_clusters(vectors, norms, k, rounds):
    """The definition, vector by vector, with lists."""
    n = len(vectors)
    top = max(range(n), key=lambda i: (norms[i], -i))
    seeds = [top]
    while len(seeds) < k:
        rest = [i for i in range(n) if i not in seeds]
        seeds.append(min(rest, key=lambda i: (max(float(vectors[i] @ vectors[s]) for s in seeds), i)) if rest else seeds[-1])
    centres, own = [vectors[s] for s in seeds], [0] * n
    for _ in range(rounds):
        now = [max(range(k), key=lambda c: (float(v @ centres[c]), -c)) for v in vectors]
        if now == own:
            break
        own = now
        for c in range(k):
            members = [i for i in range(n) if own[i] == c]
            total = sum((vectors[i] for i in members), np.zeros(vectors.shape[1]))
            size = float(np.linalg.norm(total))
            centres[c] = total / size if size > 1e-12 else vectors[max(members or range(n), key=lambda i: (norms[i], -i))]
    return own, np.array(centres)


def test_clusters_equal_plain_ones():
    rng = np.random.default_rng(8)
    for n, dim, k in ((1, 3, 1), (5, 2, 4), (12, 6, 4), (40, 8, 4), (9, 4, 3)):
        v = rng.normal(size=(n, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        norms = rng.random(n)
        own, centres = greedy.cluster(v, norms, min(k, n), 12)
        want, wanted = plain_clusters(v, norms, min(k, n), 12)
        assert own.tolist() == want and np.allclose(centres, wanted)
    v = np.array([[1.0, 0.0]] * 3)
    assert greedy.cluster(v, np.array([1.0, 2.0, 3.0]), 2, 5)[0].tolist() == [0, 0, 0]


def test_vector_sums_of_groups(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 5))
    rows = [(i % 7 if i % 11 else None, float(i % 3), v[i].tolist() if i % 13 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, w double, v array<double>").repartition(6)
    for weight, mean in ((None, False), (F.col("w"), True)):
        got = {r.k: r.v for r in vector_sum(df, ["k"], "v", weight, mean).collect()}
        for k in {r[0] for r in rows}:
            own = [(w if weight is not None else 1.0, np.array(x)) for kk, w, x in rows if kk == k and x is not None]
            total = sum(w * x for w, x in own) / (sum(w for w, _ in own) if mean else 1)
            assert np.allclose(got[k], total)
    assert vector_sum(df.filter("k = 99"), ["k"], "v").count() == 0


def test_terms_of_documents_and_columns_agree(spark):
    texts = ["ＡＢＣ ﬁne 猫犬鳥魚 x", None, "", "視頻檢索系統 2024年 demo-test_a", "a b A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tags = F.array(F.col("t"), F.lit(" Two  Words "), F.lit(None).cast("string"))
    got = df.select("t", X.tag_terms(tags).alias("tags"), X.tokens("t", nfkc=True).alias("told"), X.caption_terms(tags, F.col("t"), F.lit("end")).alias("said")).collect()
    for r in got:
        assert (r.tags, r.told, r.said) == X.field_terms([r.t, " Two  Words ", None], r.t, "end")
    q = {r.t: r.q for r in df.select("t", X.query_terms("t").alias("q")).collect()}
    assert q["ＡＢＣ ﬁne 猫犬鳥魚 x"][:2] == ["abc", "fine"] and q[None] == q[""] == []


def test_encoders_are_saved_and_restored(spark, tmp_path):
    texts = ["a cat sleeps", "", "dogs run fast", "  ", "猫が寝る"]
    one = encoders.HashEncoder(32)
    plain = one.encode(texts)
    assert np.allclose(np.linalg.norm(plain, axis=1), [1, 0, 1, 0, 1]) and np.allclose(plain[2], one.encode(["dogs  run fast "])[0])
    svd = encoders.SvdEncoder.fit(spark.createDataFrame([(t,) for t in texts if t.strip()], "t string"), "t", dim=2)
    for kind, e in (("hash", one), ("svd", svd)):
        encoders.save_encoder(e, str(tmp_path / kind))
        assert np.allclose(encoders.restore_encoder(str(tmp_path / kind)).encode(texts), e.encode(texts))
    asked = encoders.Instructed(one, "find: ")
    assert np.allclose(asked.encode(["x y"]), one.encode(["x y"])) and np.allclose(encoders.query_vectors(asked, ["x y"]), one.encode(["find: x y"]))


def test_files_of_other_formats(spark, tmp_path):
    for name, v in (("a", [3.0, 4.0]), ("b", [0.0, 0.0])):
        np.save(tmp_path / f"{name}.npy", np.array(v, np.float32))
    (tmp_path / "c.npy").write_bytes(b"no array")
    got = {r.name: r.embedding for r in files.npy_vectors(spark, str(tmp_path), normalize=True).collect()}
    assert np.allclose(got["a"], [0.6, 0.8]) and got["b"] == [0.0, 0.0] and got["c"] is None
    files.write_object(spark, {"dim": 2, "frame_ids": ["x", "y"], "index_kind": "clip"}, str(tmp_path / "side.json"))
    assert (tmp_path / "side.json").read_text().startswith('{\n  "dim": 2')
    assert [r.item_id for r in files.index_items(spark, str(tmp_path / "side.json"), "clip").orderBy("pos").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        files.index_items(spark, str(tmp_path / "side.json"), "text")
    assert files.read_object(spark, str(tmp_path / "none.json")) == {} == files.read_object(spark, str(tmp_path / "c.npy"))
    log = str(tmp_path / "log")
    files.append_jsonl(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), log)
    files.rewrite_jsonl(spark.read.json(log).filter("id = 2"), log)
    assert [r.v for r in spark.read.json(log).collect()] == ["b"]
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE videos (video_id TEXT, duration REAL)")
    db.executemany("INSERT INTO videos VALUES (?, ?)", [(f"v{i}", i / 2) for i in range(50)])
    db.commit()
    rows = files.sqlite_rows(spark, str(tmp_path / "s.db"), "videos", spark.createDataFrame([], "video_id string, duration double, status string").schema, 4).collect()
    assert {(r.video_id, r.duration, r.status) for r in rows} == {(f"v{i}", i / 2, None) for i in range(50)}
    blobs = spark.createDataFrame([("p", bytearray(b"10 4")), ("q", bytearray(b"no"))], "path string, content binary")

    def decode(data):
        a, b = bytes(data).split()
        return int(a), int(b)

    assert {r.path: r.duration for r in files.probe(blobs, decode).collect()} == {"p": 2.5, "q": 0.0}
    assert {r.path: (r.ok, r.width, r.error is None) for r in files.validated(blobs, decode).collect()} == {"p": (True, 10, True), "q": (False, 0, False)}
    sources = spark.createDataFrame([("YWJj",), ("/m/x.png",), ("http://h/x.png",)], "source string")
    named = spark.createDataFrame([("file:///m/x.png", bytearray(b"px"))], "path string, content binary")
    got = {r.source: (r.kind, None if r.bytes is None else bytes(r.bytes)) for r in files.image_bytes(sources, named).collect()}
    assert got == {"YWJj": ("base64", b"abc"), "/m/x.png": ("path", b"px"), "http://h/x.png": ("url", None)}
    kept = files.keyed_object(spark.createDataFrame([("v\"1", 1), ("v2", 2)], "video_id string, n int"), "video_id").first()
    assert json.loads(kept.json) == {'v"1': {"video_id": 'v"1', "n": 1}, "v2": {"video_id": "v2", "n": 2}}
    assert files.error_rows(spark.createDataFrame([(1, "x")], "video_id int, error string"), "embedding").first()[1:] == ("embedding", "1", "x")


def test_ingest_rewrites_touched_buckets_only(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    args = dict(table=table, checkpoint=str(tmp_path / "cp"), buckets=8)
    run = lambda: ingest.ingest_captions(ingest.caption_stream(spark, str(src)), **args).awaitTermination()
    (src / "1.json").write_text("\n".join(json.dumps({"video_id": f"v{i}", "caption": "one", "model": "m"}) for i in range(40)))
    run()
    for k in (2, 3):
        (src / f"{k}.json").write_text(json.dumps({"video_id": "v7", "caption": f"new {k}"}))
        run()
    rows = {r.video_id: (r.caption, r.model) for r in ingest.current(spark, table).collect()}
    assert len(rows) == 40 and rows["v7"] == ("new 3", "m") and rows["v8"] == ("one", "m")
    _, versions = ingest._versions(spark, table)
    assert sorted(map(len, versions.values())) == [1, 1, 7]  # the first version's bucket of v7 has gone


def test_uploads_media_and_older_names(spark, tmp_path):
    (tmp_path / "v1.png").write_bytes(b"pixels")
    found = spark.createDataFrame([("v1", 0.5)], "video_id string, score double")
    service = SearchService(
        {"hybrid": Route("hybrid", lambda: lambda request: found, lambda: 3)}, also={"older": "hybrid"},
        media=lambda route, item: str(tmp_path / f"{item}.png") if "/" not in item else None, by_image=lambda data, k: found.withColumn("k", F.lit(k)).withColumn("size", F.lit(len(data))),
    )
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def ask(path, data=None, kind="application/json"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data, {"Content-Type": kind})) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert json.loads(ask("/health")[1])["hybrid"]["index_count"] == 0
    body = json.loads(ask("/search", json.dumps({"query": "x", "mode": "hybrid"}).encode())[1])
    assert body["older"] == body["hybrid"] and body["hybrid"]["results"][0]["video_id"] == "v1"
    assert json.loads(ask("/health")[1])["hybrid"]["index_count"] == 3
    assert ask("/media/older/v1") == (200, b"pixels") and ask("/media/hybrid/v2")[0] == ask("/media/none/v1")[0] == ask("/media/hybrid/..%2Fx")[0] == 404
    code, answer = ask("/search-by-image?top_k=900", b"abc", "image/png")
    assert code == 200 and json.loads(answer)["results"][0] == {"video_id": "v1", "score": 0.5, "k": 50, "size": 3}
    assert [ask("/search-by-image", b"abc", "text/plain")[0], ask("/search-by-image", b"", "image/png")[0], ask("/search-by-image?top_k=x", b"a", "image/png")[0], ask("/else", b"")[0]] == [422, 422, 422, 404]
    assert "/health" in json.loads(ask("/")[1])["paths"]
    server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    log, table = tmp_path / "log.jsonl", str(tmp_path / "captions")
    rows = [{"video_id": "v1", "status": "ok", "description": "one", "tags": ["a"]}, {"video_id": "v2", "status": "error"}, {"video_id": "v3", "status": "ok", "caption": "no tags"}]
    log.write_text("\n".join(map(json.dumps, rows)))
    cli.main(["captions", str(log), table])
    assert [r.video_id for r in spark.read.parquet(table).collect()] == ["v1"]
    root = tmp_path / "p" / "own"
    frames = [(f"f{i}", f"s{i // 3}", "v", i / 2, [float(i % 3), 1.0], 1.0) for i in range(9)]
    spark.createDataFrame(frames, "frame_id string, segment_id string, video_id string, ts double, embedding array<double>, norm double").write.parquet(str(root / "frames"))
    cli.main(["rebuild", str(tmp_path / "p"), "own"])
    assert [spark.read.parquet(str(root / f"vectors_{n}")).count() for n in ("frame", "segment", "video")] == [9, 3, 3]
    spark.createDataFrame([("v:topk", "v", "topk", "failed", 2, 2, "e"), ("w:topk", "w", "topk", "failed", 2, 2, "e")], "task_id string, video_id string, stage string, status string, max_retry int, retry_count int, error_message string").write.parquet(str(root / "tasks"))
    cli.main(["reset", str(tmp_path / "p"), "own", "embedding", "v"])
    assert {r.video_id: (r.status, r.retry_count) for r in spark.read.parquet(str(root / "tasks")).collect()} == {"v": ("pending", 2), "w": ("failed", 2)}
    cli.main(["check", str(tmp_path / "p"), "own"])
    assert "search_documents" in capsys.readouterr().out


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


def test_cluster_needs_a_shared_folder():
    class Session:
        conf = _Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.conf = _Conf({"spark.master": "local-cluster[2,1,1024]"})
    with pytest.raises(ValueError):
        shared_dir(Session)
    Session.conf = _Conf({"spark.master": "local[2]"})
    assert shared_dir(Session).startswith("file://")
