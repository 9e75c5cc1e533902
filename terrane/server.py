"""A geocoder behind HTTP: one address for each request, in any of the formats.

    GET /geocode?address=...[&target=all][&format=json][&fuzzy=?][&debug=true]

Other paths are 404, a request that can't be answered is 400. Every answer may be
read from pages of other origins. Requests are answered one after another by the
session's geocoder; many addresses belong into a table, not into many requests.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from terrane.functions.constants import FUZZY
from terrane.plans.geocode import TARGETS
from terrane.sources import sinks


def answer(spark: SparkSession, geocode: Callable[[DataFrame], DataFrame], url: str) -> tuple[int, str, str]:
    """(status, MIME type, body) for a request's path and query."""
    parts = urlsplit(url)
    if parts.path.rstrip("/") != "/geocode":
        return 404, sinks.MIME["json"], json.dumps({"status": "error", "message": "not found"})
    given = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    address, target, kind, fuzzy = (given.get(k, d) for k, d in (("address", ""), ("target", "all"), ("format", "json"), ("fuzzy", FUZZY)))
    wrong = (
        "address is needed" if not address.strip()
        else f"target is one of {', '.join(TARGETS)}" if target not in TARGETS
        else f"format is one of {', '.join(sinks.FORMATS)}" if kind not in sinks.FORMATS
        else "fuzzy is one character" if len(fuzzy) != 1
        else None
    )
    if wrong:
        return 400, sinks.MIME["json"], json.dumps({"status": "error", "message": wrong})
    line = spark.createDataFrame([(1, address.replace(fuzzy, FUZZY), target)], "line_id long, address string, target string")
    rows = sinks.framed(geocode(line), kind, given.get("debug", "") in ("true", "1")).sort("line_id").collect()
    return 200, sinks.MIME[kind], "".join(r["value"] + "\n" for r in rows)


def server(spark: SparkSession, geocode: Callable[[DataFrame], DataFrame], port: int = 3000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't started yet: serve_forever() starts it, shutdown() ends it."""
    one = Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with one:
                status, mime, body = answer(spark, geocode, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{mime}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
