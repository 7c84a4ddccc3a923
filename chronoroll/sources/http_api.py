"""Queries over HTTP: results as JSON, and kept results by their permanent names.

``GET /run?sql=...`` answers a query, ``GET /keep?sql=...`` keeps its result and answers with its name, and
``GET /kept/NAME`` gives it again, to other sessions too.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..engine import Engine
from ..plans.parser import QueryError

#: Bytes of a response at most, seconds of a query, and queries that run at a time.
RESPONSE, SECONDS, AT_ONCE = 25 << 20, 1800.0, 2


def as_json(df: DataFrame, most: int = RESPONSE) -> bytes:
    """Columns and rows; an error if they take more bytes than ``most``. Rows come one partition at a time."""
    out, size = [], 0
    for r in df.toLocalIterator():
        row = json.dumps([x.isoformat() if hasattr(x, "isoformat") else x for x in r])
        size += len(row) + 1
        if size > most:
            raise QueryError(f"the result is larger than {most} bytes")
        out.append(row)
    return f'{{"columns": {json.dumps(df.columns)}, "rows": [{",".join(out)}]}}'.encode()


def serve(engine: Engine, folder: str, host: str = "127.0.0.1", port: int = 0, most: int = RESPONSE, seconds: float = SECONDS) -> ThreadingHTTPServer:
    """A server that runs in a thread of its own; ``server_port`` says where, ``shutdown`` ends it."""
    free = threading.BoundedSemaphore(AT_ONCE)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            sql = parse_qs(url.query).get("sql", [""])[0]
            try:
                with free:
                    if url.path == "/run":
                        body = engine.within(seconds, sql, lambda: as_json(engine.query(sql), most))
                    elif url.path == "/keep":
                        body = json.dumps({"name": engine.within(seconds, sql, lambda: engine.keep(sql, folder))}).encode()
                    elif url.path.startswith("/kept/"):
                        body = as_json(engine.kept(url.path.removeprefix("/kept/"), folder), most)
                    else:
                        return self._answer(404, b'{"error": "no such path"}')
            except (QueryError, AnalysisException, ValueError) as e:
                return self._answer(400, json.dumps({"error": str(e)}).encode())
            self._answer(200, body)

        def _answer(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
