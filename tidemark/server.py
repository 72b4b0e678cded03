"""The service over HTTP: JSON calls, and binary ones with Arrow streams."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidemark import wire
from tidemark.errors import BadRequest, TidemarkError
from tidemark.operators import lookup
from tidemark.service import Service

#: HTTP statuses of the service's own.
HTTP = {
    "OK": 200, "BAD_REQUEST": 400, "SCHEMA_MISMATCH": 409, "NOT_SUPPORTED": 501, "OVERLOADED": 503, "SHUTTING_DOWN": 503, "LOOKUP_UNAVAILABLE": 503, "INTERNAL_ERROR": 500,
}
GETS = {"health": "health", "state": "state", "handshake": "handshake"}
POSTS = {
    "write": "write", "writeBatch": "write_batch", "delete": "delete", "get": "get", "getLocal": "get_local", "prefix": "prefix", "prefixLocal": "prefix_local",
    "flush": "flush", "sink": "sink",
}
FENCES = ("flush", "sink")  #: answered with 202: done when the state's sequences are there


class Server:
    """One table's service on a port (0: any free one). Calls are one at a time, as a table has one writer."""

    def __init__(self, service: Service, port: int = 0, max_bytes: int = 16 << 20):
        self.service, self.max_bytes, self.lock = service, max_bytes, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def do_GET(self) -> None:
                name = self.path.strip("/")
                self.answer(*outer.json(GETS.get(name), name, []))

            def do_POST(self) -> None:
                size, name = int(self.headers.get("Content-Length") or 0), self.path.strip("/")
                if size > outer.max_bytes:
                    self.close_connection = True
                    return self.answer(*outer.failed(BadRequest(f"more than {outer.max_bytes} bytes")))
                body = self.rfile.read(size)
                if self.headers.get("Content-Type") == wire.TYPE:
                    return self.answer(*outer.binary(name, body))
                try:
                    args = [json.loads(body)] if body else []
                except ValueError as e:
                    return self.answer(*outer.failed(BadRequest(f"no JSON: {e}")))
                self.answer(*outer.json(POSTS.get(name), name, args))

            def answer(self, status: int, kind: str, body: bytes) -> None:
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_: object) -> None:
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.http.server_address[1]
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    @staticmethod
    def failed(e: Exception) -> tuple[int, str, bytes]:
        status = e.status if isinstance(e, TidemarkError) else "INTERNAL_ERROR"
        return HTTP.get(status, 500), "application/json", json.dumps({"status": status, "message": str(e)}).encode()

    def json(self, method: str | None, name: str, args: list) -> tuple[int, str, bytes]:
        if method is None:
            return self.failed(BadRequest(f"no call {name}"))
        with self.lock:
            try:
                result = getattr(self.service, method)(*args)
            except Exception as e:
                return self.failed(e)
        return 202 if name in FENCES else 200, "application/json", json.dumps({"status": "OK", "result": result}, default=str).encode()

    def binary(self, name: str, body: bytes) -> tuple[int, str, bytes]:
        """put, delete and writeBatch take changes; get, getLocal and getPrefix take one key, or leading columns of one."""
        t = self.service.table
        with self.lock:
            try:
                if name in ("put", "delete", "writeBatch"):
                    last = t.write_batch(wire.decode_changes(t.spec, body))
                    return 200, "application/json", json.dumps({"status": "OK", "result": {"sequence": last}}).encode()
                names = wire._table(body).column_names
                keys = wire.decode_rows(t.spec, body, names)
                if name == "getLocal":
                    found = [(k, r and r.asDict()) for k, r in (lookup.get_local(t, key) for key in keys)]
                elif name == "get":
                    found = [("HIT" if r else "MISS", r and r.asDict()) for r in (lookup.get(t, key) for key in keys)]
                elif name == "getPrefix":
                    found = [("HIT", r.asDict()) for key in keys for r in lookup.prefix_local(t, key)]
                else:
                    raise BadRequest(f"no binary call {name}")
                return 200, wire.TYPE, wire.encode_lookups(t.spec, found)
            except Exception as e:
                return self.failed(e)
