"""The service, profiles, settings and small JSON functions."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from framequarry import catalog, service
from framequarry.functions import captions, paths


def test_service_isolates_routes_and_answers_http(spark):
    found = spark.createDataFrame([("v1", 0.5, [(1.0, 2.0, 0.3)])], "video_id string, score double, segments array<struct<start:double,end:double,score:double>>")
    docs = spark.createDataFrame([("v2", 0.4, "d", ["t"], 1)], "video_id string, score double, description string, tags array<string>, sparse_rank int")

    def broken():
        raise OSError("no index")

    s = service.SearchService({"clip": service.Route("clip", lambda: lambda r: found, lambda: 3), "hybrid": service.Route("hybrid", broken)})
    got = s.search(service.Request("cat"))
    assert got["clip"]["results"][0]["display_line"] == "1.0-2.0 s (0.300)" and got["clip"]["index_count"] == 3 and got["clip"]["error"] is None
    assert "no index" in got["hybrid"]["error"] and got["hybrid"]["results"] == [] and s.health()["hybrid"]["error"]
    s.routes["hybrid"].load = lambda: lambda r: docs
    assert "clip" not in s.search(service.Request("cat", mode="hybrid"))
    s.routes["clip"].warm_up().join()
    http = service.serve(s, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    body = json.dumps({"query": "cat", "mode": "hybrid"}).encode()
    answer = json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/search", body)))
    assert answer["hybrid"]["results"][0]["tags"] == ["t"] and json.load(urllib.request.urlopen(f"{url}/health"))["hybrid"]["ready"]
    for bad in (b"{}", b'{"query": ""}', b'{"query": "a", "mode": "x"}', b"no"):
        with pytest.raises(urllib.error.HTTPError, match="422"):
            urllib.request.urlopen(urllib.request.Request(f"{url}/search", bad))
    http.shutdown()
    files = spark.createDataFrame([("/m/v1.mp4",)], "path string")
    hit = service.attach_media(service.hits(found), files).first()
    assert (hit.resolved_path, hit.available, hit.url) == ("/m/v1.mp4", True, "/media/v1")


def test_profiles_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "old/p/videos").mkdir(parents=True)
    (tmp_path / "new/p/frames").mkdir(parents=True)
    p = catalog.Profile("p", str(tmp_path / "new"), str(tmp_path / "old"))
    assert p.path(spark, "videos").startswith(str(tmp_path / "old")) and p.path(spark, "tasks").startswith(str(tmp_path / "new"))
    assert p.check(spark, ("videos", "frames", "tasks")) == ["tasks"]
    with pytest.raises(RuntimeError, match="tasks"):
        p.check(spark, ("tasks",), strict=True)
    assert catalog.parse_env("# c\nexport A = 'x y'\nB=\"z\"\nbad\n=v\nC=1=2") == {"A": "x y", "B": "z", "C": "1=2"}
    monkeypatch.setenv("FQ_B", " v ")
    assert catalog.env_first("FQ_A", "FQ_B") == "v" and catalog.env_first("FQ_A") is None


def test_response_texts(spark):
    rows = ['{"choices":[{"message":{"content":" a "}}]}', '{"choices":[{"message":{"content":[{"text":"a"},{"type":"x"},{"text":" b "}]}}]}', '{"output_text":"c"}', '{"output":[{"content":[{"text":"d"}]},{"content":[{"text":"e"}]}]}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [r.t for r in df.select(captions.response_text("r").alias("t")).collect()] == ["a", "a\nb", "c", "d\ne", ""]
    m = df.limit(1).select(captions.prompt_messages(F.lit("p"), F.array(F.lit(b"ab"))).alias("m")).first().m
    assert [tuple(x) for x in m] == [("text", "p"), ("image_url", "data:image/jpeg;base64,YWI=")]
    src = spark.createDataFrame([("HTTP://x/y.png",), ("/a/b",), ("YWI=",), ("x/y.JPG",), ("?!",)], "s string").select(paths.image_source("s").alias("v")).collect()
    assert [(r.v.kind, bytes(r.v.bytes) if r.v.bytes is not None else None) for r in src] == [("url", None), ("path", None), ("base64", b"ab"), ("path", None), ("base64", None)]
