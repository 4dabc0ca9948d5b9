"""The reader over HTTP, with the standard library alone: GET requests in, JSON out.

/health, /users/{id}/transactions, /users/{id}/aggregates, /users/{id}/anomalies
and /anomalies, with limit, cursor, start_time, end_time and anomaly_type as
query parameters.  A limit that is no number or out of range, or a time that
doesn't parse, is a 422, any other wrong parameter a 400, an unknown path a
404; 503 says that the engine or all its places are taken.
"""

from __future__ import annotations

import json
import re
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .reader import LEAST, MOST, USUAL, AnalyticsReader, BadRequest, Page

USER = re.compile(r"/users/([^/]+)/(transactions|aggregates|anomalies)\Z")
TIMES = ("start_time", "end_time")


class Unparseable(BadRequest):
    """A parameter that isn't of its type."""


def _given(query: str, allowed: tuple[str, ...]) -> dict:
    given = {k: v[-1] for k, v in parse_qs(query, keep_blank_values=True).items() if k in allowed}
    for name in TIMES:
        if name in given:
            try:
                given[name] = datetime.fromisoformat(given[name].replace("Z", "+00:00").replace(" ", "+"))
            except ValueError as e:
                raise Unparseable(f"{name} is no ISO time") from e
    try:
        given["limit"] = int(given.get("limit", USUAL))
    except ValueError as e:
        raise Unparseable("limit is a number") from e
    return given


def respond(reader: AnalyticsReader, target: str) -> tuple[int, dict]:
    """Status and body for a request path with its query."""
    url = urlsplit(target)
    try:
        if url.path == "/health":
            return (200, {"status": "ok"}) if reader.health() else (503, {"status": "unavailable"})
        if url.path == "/anomalies":
            fetch, names = reader.all_anomalies, ("limit", "cursor", "anomaly_type")
        elif m := USER.match(url.path):
            user, what = unquote(m[1]), m[2]
            names = ("limit", "cursor", *(("anomaly_type",) if what == "anomalies" else TIMES))
            fetch = lambda **given: getattr(reader, f"user_{what}")(user, **given)
        else:
            return 404, {"detail": "not found"}
        given = _given(url.query, names)
        if not LEAST <= given["limit"] <= MOST:
            return 422, {"detail": f"limit is {LEAST} to {MOST}"}
        page: Page = fetch(**given)
        return 200, {"items": [r.asDict() for r in page.items], "next_cursor": page.next_cursor}
    except Unparseable as e:
        return 422, {"detail": str(e)}
    except BadRequest as e:
        return 400, {"detail": str(e)}
    except Exception as e:
        return 503, {"error": "engine unavailable", "detail": type(e).__name__}


def serve(reader: AnalyticsReader, host: str = "127.0.0.1", port: int = 8000, at_once: int = 10, wait_s: float = 2.0) -> ThreadingHTTPServer:
    """A server that isn't running yet; a request that finds no free place within ``wait_s`` gets a 503."""
    if not 0 <= port < 65_536 or at_once < 1 or wait_s < 0:
        raise ValueError("port, places and waiting time are out of range")
    places = threading.BoundedSemaphore(at_once)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            if places.acquire(timeout=wait_s):
                try:
                    status, body = respond(reader, self.path)
                finally:
                    places.release()
            else:
                status, body = 503, {"error": "all places taken", "detail": f"waited {wait_s} s"}
            data = json.dumps(body, default=lambda v: v.isoformat() if isinstance(v, date) else str(v)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
