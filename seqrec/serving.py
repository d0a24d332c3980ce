"""Point lookups on a table of ready responses, and an HTTP facade over them.

Recommendations are made for all users at once (operators/generative.py); a request reads one row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, functions as F

#: What a request asks for if it doesn't say.
DEFAULT_K = 20


def require_paths(paths: dict[str, str]) -> None:
    missing = sorted(name for name, p in paths.items() if not Path(p).exists())
    if missing:
        raise FileNotFoundError(f"missing artifacts: {', '.join(missing)}")


def lookup(served: DataFrame, most: int | None = None, anyone: int | None = None) -> Callable[[int, int], dict]:
    """A function of user and k over a serving table (query_id, rank, item_id, title, semantic_id, score).

    most: the k that the table was made for; more is refused instead of cut. anyone: the query_id whose
    rows, made from an empty history, answer users without rows of their own.
    """

    def get(user_id: int, k: int = DEFAULT_K) -> dict:
        if user_id < 1 or k < 1:
            raise ValueError("user_id and k start at 1")
        if most is not None and k > most:
            raise ValueError(f"k is at most {most} here")
        start = time.perf_counter()
        ids = [user_id] if anyone is None else [user_id, anyone]
        rows = served.where(F.col("query_id").isin(ids) & (F.col("rank") <= k)).orderBy("rank").collect()
        own = [r for r in rows if r.query_id == user_id]
        rows = own or rows
        items = [{"item_id": r.item_id, "title": r.title, "semantic_id": list(r.semantic_id), "score": r.score} for r in rows]
        return {"user_id": user_id, "model": "generative", "decoder": "prefix_index", "items": items, "latency_ms": (time.perf_counter() - start) * 1000}

    return get


def server(get: Callable[[int, int], dict], port: int = 0) -> ThreadingHTTPServer:
    """GET /recommendations/users/{id}?k=20; 422 for numbers out of range, 404 for other paths."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            parts = url.path.strip("/").split("/")
            if parts[:2] != ["recommendations", "users"] or len(parts) != 3:
                return self._send(404, {"detail": "not found"})
            try:
                self._send(200, get(int(parts[2]), int(parse_qs(url.query).get("k", [DEFAULT_K])[0])))
            except ValueError as e:
                self._send(422, {"detail": str(e)})

        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
