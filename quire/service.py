"""A local HTTP service over a corpus: health, sources and questions as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from quire.engine import Corpus
from quire.providers import Provider


def respond(corpus: Corpus, provider: Provider | None, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of one request: 404 unknown, 422 invalid, 503 while there is no current index."""
    if method == "GET" and path in ("/health", "/api/health"):
        return 200, corpus.health()
    if method == "GET" and path.removeprefix("/api").startswith("/source/"):
        found = corpus.source(unquote(path.rsplit("/", 1)[1]))
        return (200, found) if found else (404, {"detail": "no such source"})
    if method == "POST" and path == "/api/ask":
        try:
            asked = json.loads(body)
            question, audience = asked["question"], asked.get("audience", "clinician")
            if not isinstance(question, str):
                raise ValueError("a question is text")
        except (ValueError, KeyError, TypeError, AttributeError):
            return 422, {"detail": "a JSON object with a question"}
        if corpus.health()["status"] != "ready":
            return 503, {"detail": "the index is not ready"}
        try:
            return 200, corpus.ask(question, audience, provider)
        except ValueError as error:
            return 422, {"detail": str(error)}
    return 404, {"detail": "not found"}


def serve(corpus: Corpus, provider: Provider | None = None, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Serve until stopped; on this machine only."""
    if host not in ("127.0.0.1", "localhost", "::1"):
        raise ValueError("the service listens on this machine only")

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = respond(corpus, provider, self.command, self.path.split("?", 1)[0], self.rfile.read(size))
            data = json.dumps(found, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

    ThreadingHTTPServer((host, port), Handler).serve_forever()
