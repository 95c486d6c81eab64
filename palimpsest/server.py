"""A socket service: frames of a big-endian 32-bit length and a JSON object.

Requests have id, method and params; answers id, ok, and result or error.  Methods: hello; query with
``sql``; refs; get with ``hash``.  One request runs at a time; its intermediate tables go when it is
answered.  A frame that is empty, too large or no JSON object ends its connection.
"""

from __future__ import annotations

import base64
import json
import socketserver
import struct
import threading
from typing import Any

from palimpsest.engine import Engine, QueryResult
from palimpsest.errors import PalimpsestError
from palimpsest.shared import scope
from palimpsest.sources.repository import Repository

MAX_FRAME = 16 * 1024 * 1024
METHODS = ("hello", "query", "refs", "get")
VERSION = "1.0.0"


class _Connection(socketserver.StreamRequestHandler):
    server: Server

    def handle(self) -> None:
        while len(head := self.rfile.read(4)) == 4:
            (length,) = struct.unpack(">I", head)
            if not 0 < length <= MAX_FRAME:
                return
            try:
                request = json.loads(self.rfile.read(length))
                number, method, params = request["id"], str(request["method"]), request.get("params") or {}
            except (ValueError, KeyError, TypeError):
                return
            body = json.dumps(self.server.answer(number, method, params)).encode()
            if len(body) > MAX_FRAME:
                return
            self.wfile.write(struct.pack(">I", len(body)) + body)


class Server(socketserver.ThreadingTCPServer):
    """Serves one repository."""

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, repo: Repository, address: tuple[str, int]):
        self.repo, self._lock = repo, threading.Lock()
        super().__init__(address, _Connection)

    def answer(self, number: Any, method: str, params: dict[str, Any]) -> dict[str, Any]:
        """The answer to one request."""
        try:
            with self._lock, scope():
                return {"id": number, "ok": True, "result": self._result(method, params)}
        except (PalimpsestError, ValueError) as e:
            return {"id": number, "ok": False, "error": str(e)}

    def _result(self, method: str, params: dict[str, Any]) -> dict[str, Any]:
        if method == "hello":
            return {"protocol": "palimpsest", "version": 1, "server": VERSION, "methods": list(METHODS)}
        if method == "refs":
            return {"branches": [{"name": n, "tip": self.repo.get_branch(n).hash} for n in self.repo.list_branches()]}
        if method == "query":
            if not isinstance(params.get("sql"), str) or not params["sql"]:
                raise ValueError("params.sql required")
            return {"results": [_as_json(r) for r in Engine(self.repo).execute(params["sql"])]}
        if method == "get":
            if not isinstance(params.get("hash"), str) or not params["hash"]:
                raise ValueError("params.hash required")
            found = self.repo.get_object(params["hash"])
            payload = json.dumps(found, sort_keys=True).encode()
            return {"hash": found["hash"], "type": "commit", "payload_base64": base64.b64encode(payload).decode(), "len": len(payload)}
        raise ValueError(f"unknown method '{method}'")


def _as_json(result: Any) -> dict[str, Any]:
    if isinstance(result, QueryResult):
        return {"type": "query", "columns": result.columns, "rows": [list(r) for r in result.rows()]}
    return {"type": "mutation", "summary": result.summary, "hash": result.hash}
