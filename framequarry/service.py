"""A search service over the engines: one request to one or more routes, each failing by itself; HTTP on top of it."""

from __future__ import annotations

import json
import mimetypes
import os
import shutil
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.config import validate_request
from framequarry.functions.captions import format_intervals

MODES = ("clip", "hybrid", "both")


@dataclass
class Request:
    query: str
    mode: str = "both"
    top_k: int = 10
    sparse_top_k: int | None = None
    dense_top_k: int | None = None
    rrf_k: int | None = None

    def __post_init__(self) -> None:
        validate_request(self.query, self.top_k, sparse_top_k=self.sparse_top_k, dense_top_k=self.dense_top_k, rrf_k=self.rrf_k)
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


@dataclass
class Route:
    """An engine that is loaded once, on first use or in the background: ``load`` returns a search function."""

    name: str
    load: Callable[[], Callable[[Request], DataFrame]]
    count: Callable[[], int] = lambda: 0
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _search: Callable[[Request], DataFrame] | None = None
    starting: bool = False
    error: str | None = None

    def ready(self) -> Callable[[Request], DataFrame]:
        with self._lock:
            if self._search is None:
                self.starting = True
                try:
                    self._search, self.error = self.load(), None
                except Exception as e:  # a route that can't load must not take the other one with it
                    self.error = f"{type(e).__name__}: {e}"
                    raise RuntimeError(self.error) from e
                finally:
                    self.starting = False
            return self._search

    def warm_up(self) -> threading.Thread:
        def quietly() -> None:
            try:
                self.ready()(Request("warm-up", top_k=1)).limit(1).collect()
            except Exception as e:
                self.error = f"{type(e).__name__}: {e}"

        thread = threading.Thread(target=quietly, daemon=True)
        thread.start()
        return thread

    def block(self, request: Request) -> dict:
        began, rows, error = time.perf_counter(), [], None
        try:
            rows = [json.loads(r.j) for r in hits(self.ready()(request)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
        except Exception as e:
            error = str(e)
        return {"mode": self.name, "index_count": self.count() if error is None else 0, "elapsed_ms": round((time.perf_counter() - began) * 1000, 1), "ready": self._search is not None, "error": error, "results": rows}


def hits(found: DataFrame) -> DataFrame:
    """Hits of any engine in one shape: video_id, score, description, display_line, tags, segments, video_path, ranks."""
    have = set(found.columns)
    text = F.trim(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("description", "caption") if c in have], F.lit("")))
    intervals = F.col("segments") if "segments" in have else F.array().cast("array<struct<start:double,end:double,score:double>>")
    line = F.coalesce(F.nullif(text, F.lit("")), format_intervals(intervals), F.lit(""))
    pick = lambda c, default: F.coalesce(F.col(c), default).alias(c) if c in have else default.alias(c)
    return found.select(
        F.col("video_id").cast("string").alias("video_id"), F.coalesce("score", F.lit(0.0)).alias("score"), line.alias("description"), line.alias("display_line"),
        pick("tags", F.array().cast("array<string>")), intervals.alias("segments"), pick("video_path", F.lit("")), *[F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in ("sparse_rank", "dense_rank")],
    )


#: What an upload may be, and how many hits it may ask for.
UPLOADS = "image/"
MOST_HITS = 50


@dataclass
class SearchService:
    """routes by name; older clients' names for routes; media(route, id) gives a file's path; by_image(bytes, top_k) searches by a picture."""

    routes: dict[str, Route]
    also: dict[str, str] = field(default_factory=dict)
    media: Callable[[str, str], str | None] = lambda route, item: None
    by_image: Callable[[bytes, int], DataFrame] | None = None

    def search_image(self, kind: str, data: bytes, top_k: int = 10) -> dict:
        """Hits of an uploaded picture; raises ValueError for what isn't one. top_k is held between 1 and 50."""
        if self.by_image is None:
            raise ValueError("no search by picture")
        if not (kind or "").lower().startswith(UPLOADS):
            raise ValueError(f"not a picture: {kind or 'no content type'}")
        if not data:
            raise ValueError("the upload is empty")
        began, top_k = time.perf_counter(), min(MOST_HITS, max(1, top_k))
        rows = [json.loads(r.j) for r in self.by_image(data, top_k).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
        return {"top_k": top_k, "elapsed_ms": round((time.perf_counter() - began) * 1000, 1), "results": rows}

    def file(self, route: str, item: str) -> str | None:
        """The path of a route's medium, null if there is none."""
        name = self.also.get(route, route)
        return self.media(name, item) if name in self.routes else None

    def search(self, request: Request) -> dict:
        began = time.perf_counter()
        names = [n for n in self.routes if request.mode in (n, "both")]
        blocks = {n: self.routes[n].block(request) for n in names}
        blocks |= {old: blocks[n] for old, n in self.also.items() if n in blocks}
        return {"query": request.query, "mode": request.mode, "top_k": request.top_k, "elapsed_ms": round((time.perf_counter() - began) * 1000, 1), **blocks}

    def health(self) -> dict:
        """Of each route whether it is ready or starting, its last error, and the size of its index once it is ready."""
        return {n: {"ready": r._search is not None, "starting": r.starting, "error": r.error, "index_count": r.count() if r._search is not None else 0} for n, r in self.routes.items()}


def attach_media(found: DataFrame, files: DataFrame, key: str = "video_id", path: str = "video_path") -> DataFrame:
    """Hits with resolved_path (stored path or a file named as the key), available and url."""
    named = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("__name"), F.col("path").alias("__by_name")).groupBy("__name").agg(F.min("__by_name").alias("__by_name"))
    exact = files.select(F.col("path").alias("__exact")).distinct()
    out = found.join(exact, F.col(path) == F.col("__exact"), "left").join(named, F.col(key).cast("string") == F.col("__name"), "left")
    resolved = F.coalesce("__exact", "__by_name")
    return out.withColumns({"resolved_path": resolved, "available": resolved.isNotNull(), "url": F.when(resolved.isNotNull(), F.concat(F.lit("/media/"), F.col(key).cast("string")))}).drop("__exact", "__name", "__by_name")


def serve(service: SearchService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """POST /search and /search-by-image, GET /health, /media/ROUTE/ID and / (the routes); start it with serve_forever.

    /search-by-image takes the picture as the body, with its content type, and ?top_k=N.
    """

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, kind: str, data: bytes) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _reply(self, code: int, body: dict) -> None:
            self._send(code, "application/json; charset=utf-8", json.dumps(body, ensure_ascii=False).encode())

        def do_GET(self) -> None:
            path = unquote(urlsplit(self.path).path)
            if path == "/health":
                return self._reply(200, service.health())
            if path == "/":
                return self._reply(200, {"routes": sorted(service.routes), "paths": ["/search", "/search-by-image", "/health", "/media/{route}/{id}"]})
            head, _, rest = path.lstrip("/").partition("/")
            route, _, item = rest.partition("/")
            found = service.file(route, item) if head == "media" and item else None
            if found is None or not os.path.isfile(found):
                return self._reply(404, {"error": "not found"})
            self.send_response(200)
            self.send_header("Content-Type", mimetypes.guess_type(found)[0] or "application/octet-stream")
            self.send_header("Content-Length", str(os.path.getsize(found)))
            self.end_headers()
            with open(found, "rb") as f:
                shutil.copyfileobj(f, self.wfile)

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                if url.path == "/search":
                    return self._reply(200, service.search(Request(**json.loads(body))))
                if url.path == "/search-by-image":
                    top_k = int(dict(parse_qsl(url.query)).get("top_k", 10))
                    return self._reply(200, service.search_image(self.headers.get("Content-Type") or "", body, top_k))
            except (TypeError, ValueError) as e:
                return self._reply(422, {"error": str(e)})
            return self._reply(404, {"error": "not found"})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
