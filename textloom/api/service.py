"""A small service over the analyses of single texts: POST /api/analyze and GET /api/health. For clusters there are the SQL functions."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from textloom.api.analysis import Analyzer

MAX_BYTES = 2_000_000


def analyze(analyzer: Analyzer, body: bytes) -> tuple[int, dict]:
    """(status, answer) of a request ``{"text", "maxBlocks" (1 to 100), "threshold" (0 to 1)}``."""
    if len(body) > MAX_BYTES:
        return 413, {"error": f"more than {MAX_BYTES} bytes"}
    try:
        request = json.loads(body)
        text, blocks, threshold = request["text"], request.get("maxBlocks", 3), request.get("threshold", 0.35)
    except (ValueError, KeyError, TypeError, AttributeError):
        return 400, {"error": "a JSON object with a text is wanted"}
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(text, str) or not isinstance(blocks, int) or isinstance(blocks, bool) or not 1 <= blocks <= 100 or not number(threshold) or not 0 <= threshold <= 1:
        return 400, {"error": "text, maxBlocks or threshold out of bounds"}
    s = analyzer.segmenter
    rows = analyzer.summary(analyzer.frame([text]), blocks, float(threshold)).drop("doc").collect()
    return 200, {"tokens": s.tokenize(text), "sentences": s.split_sentences(text), "summary": rows[0].asDict() if rows else None}


def serve(analyzer: Analyzer, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """The server, ready to ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, answer: dict) -> None:
            data = json.dumps(answer, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(*((200, {"status": "ok"}) if self.path == "/api/health" else (404, {"error": "not found"})))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/api/analyze":
                self._answer(404, {"error": "not found"})
            elif size > MAX_BYTES:
                self.close_connection = True
                self._answer(413, {"error": f"more than {MAX_BYTES} bytes"})
            else:
                self._answer(*analyze(analyzer, self.rfile.read(size)))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
