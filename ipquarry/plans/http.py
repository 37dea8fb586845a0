"""Answers over HTTP: /indexers, /search, /stats, /expandcidr and /dump, each also under /v1."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from ipquarry.functions.ips import format_ip
from ipquarry.operators.store import said
from ipquarry.plans.engine import Engine


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    began = False

    def log_message(self, *_) -> None:
        pass

    def do_GET(self) -> None:
        self.began = False
        parts = urlsplit(self.path)
        route = parts.path.removeprefix("/v1")
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        handle = {"/indexers": self.indexers, "/search": self.search, "/stats": self.stats, "/expandcidr": self.expand, "/dump": self.dump}.get(route)
        if handle is None:
            return self.answer(404, "404 page not found")
        if route != "/indexers":
            for name in ("i", "q"):
                if not asked.get(name):
                    return self.answer(400, f"Missing parameter: {name}")
        try:
            handle(asked)
        except (BrokenPipeError, ConnectionError):
            pass
        except (ValueError, KeyError) as error:
            self.fail(str(error.args[0]))
        except (OSError, PySparkException, Py4JJavaError) as error:
            self.fail(said(error))

    def fail(self, text: str) -> None:
        """500, or, where rows have been sent already, the text after them."""
        if self.began:
            self.wfile.write((text + "\n").encode())
        else:
            self.answer(500, text)

    def answer(self, status: int, text: str, kind: str = "text/plain; charset=utf-8") -> None:
        body = (text + "\n").encode() if text else b""
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def lines(self, rows, missing: list[str] | None = None) -> None:
        """Rows of one string, sent as they come; the first is fetched before the head, so errors still show.

        Files that are missing are named in a head of their own; with no row at all they are an error.
        """
        rows = rows.toLocalIterator()
        first = next(rows, None)
        if missing and first is None:
            return self.answer(500, f"indexed files are gone: {', '.join(missing)}")
        self.send_response(200)
        self.began = True
        if missing:
            self.send_header("X-Missing-Files", quote(",".join(missing), safe="/,:"))
        self.send_header("Content-Type", "text/plain; charset=utf-8")
        self.end_headers()
        while first is not None:
            self.wfile.write((first[0] + "\n").encode())
            first = next(rows, None)

    def indexers(self, _: dict) -> None:
        self.answer(200, json.dumps(self.engine.indexers() or None), "application/json")

    def search(self, asked: dict) -> None:
        self.lines(self.engine.search(asked["i"], asked["q"]).select("filename"))

    def stats(self, asked: dict) -> None:
        self.answer(200, json.dumps(self.engine.stats(asked["i"], asked["q"], asked.get("bucket", ""))), "application/json")

    def expand(self, asked: dict) -> None:
        self.lines(self.engine.expand(asked["i"], asked["q"]).select(format_ip("ip")))

    def dump(self, asked: dict) -> None:
        missing: list[str] = []
        self.lines(self.engine.dump(asked["i"], asked["q"], missing=missing).select("value"), missing)


def serve(engine: Engine, bind: str | None = None) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever(); bind is host:port."""
    host, _, port = (bind or engine.config.bind).rpartition(":")
    return ThreadingHTTPServer((host, int(port)), type("OwnHandler", (Handler,), {"engine": engine}))
