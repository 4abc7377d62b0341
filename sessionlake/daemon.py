"""The service over a socket: seven operations, many readers, one writer.

A message is four bytes of length (big endian) and as many of JSON, at most ``MOST_BYTES``. Requests and answers are those of :mod:`sessionlake.api`, with
``ingest`` and ``reindex`` besides. Reads run together in a pool of two to eight; writes one after another. A loopback address or a
socket file is all it listens on unless ``remote`` is asked for, as there is neither encryption nor a password. ``reconstruct``
writes only below ``reconstruct_root``, and not at all without one.
"""

from __future__ import annotations

import ipaddress
import json
import os
import socket
import socketserver
import struct
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath
from typing import Any

from . import api
from .archive import Archive

MOST_BYTES = 64 * 1024 * 1024
WRITES = ("ingest", "reindex")


def receive(connection: socket.socket) -> bytes | None:
    """One message; None at the end."""

    def exactly(n: int) -> bytes | None:
        parts, left = [], n
        while left:
            part = connection.recv(min(left, 1 << 20))
            if not part:
                return None
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    head = exactly(4)
    if head is None:
        return None
    (n,) = struct.unpack(">I", head)
    if n > MOST_BYTES:
        raise api.Refused("invalid_argument", f"a message of {n} bytes; at most {MOST_BYTES} are taken")
    return exactly(n)


def send(connection: socket.socket, value: Any) -> None:
    raw = json.dumps(value, ensure_ascii=False).encode()
    if len(raw) > MOST_BYTES:
        raw = json.dumps({"ok": False, "error": {"code": "operation_failed", "message": f"the answer has {len(raw)} bytes; at most {MOST_BYTES} are sent"}}).encode()
    connection.sendall(struct.pack(">I", len(raw)) + raw)


class Daemon:
    def __init__(self, archive: Archive, listen: str = "127.0.0.1:50051", socket_path: str | None = None, remote: bool = False, reconstruct_root: str | None = None, readers: int | None = None):
        self.archive, self.root = archive, reconstruct_root
        self.pool = ThreadPoolExecutor(max(2, min(8, readers or os.cpu_count() or 2)))
        self.writer = threading.Lock()
        daemon = self

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                try:
                    while (message := receive(self.request)) is not None:
                        send(self.request, daemon.answer(message))
                except api.Refused as e:
                    send(self.request, {"ok": False, "error": {"code": e.code, "message": str(e)}})
                except ConnectionError:
                    return

        if socket_path:
            kind, at = socketserver.ThreadingUnixStreamServer, socket_path
        else:
            host, _, port = listen.rpartition(":")
            if not remote and not (host == "localhost" or ipaddress.ip_address(host).is_loopback):
                raise ValueError(f"{listen} is no loopback address")
            kind, at = socketserver.ThreadingTCPServer, (host, int(port))
        kind.daemon_threads = kind.allow_reuse_address = True
        self.server, self.socket_path = kind(at, Handler), socket_path

    @property
    def address(self) -> Any:
        return self.server.server_address

    def answer(self, message: bytes) -> dict[str, Any]:
        operations = api.OPERATIONS | {"ingest": self.ingest, "reindex": self.reindex, "reconstruct": self.reconstruct}
        try:
            writes = json.loads(message).get("op") in WRITES
        except (ValueError, AttributeError):
            writes = False
        if not writes:
            return self.pool.submit(api.answer, self.archive, message, operations).result()
        with self.writer:
            return api.answer(self.archive, message, operations)

    @staticmethod
    def ingest(archive: Archive, f: api.Fields) -> Any:
        agents = f.get("agents", list)
        report = archive.ingest(**({"agents": tuple(agents)} if agents else {}), root=f.get("root", str), since_ms=f.since(), exclude=tuple(f.get("exclude", list, ())), dry_run=f.get("dry_run", bool, False))
        return vars(report)

    @staticmethod
    def reindex(archive: Archive, f: api.Fields) -> Any:
        archive.reindex()
        return {"indexed": archive.manifest()["index"]["n_docs"]}

    def reconstruct(self, archive: Archive, f: api.Fields) -> Any:
        if self.root is None:
            raise api.Refused("permission_denied", "this service reconstructs nothing")
        out = PurePosixPath(f.need("out"))
        if out.is_absolute() or ".." in out.parts:
            raise api.Refused("invalid_argument", f"unsafe folder {out}")
        return [x["path"] for x in archive.restore(f.need("id"), os.path.join(self.root, out), f.get("overwrite", bool, False))["files"]]

    def run(self) -> None:
        try:
            self.server.serve_forever()
        finally:
            self.close()

    def close(self) -> None:
        self.server.server_close()
        self.pool.shutdown(wait=False)
        if self.socket_path and os.path.exists(self.socket_path):
            os.unlink(self.socket_path)


def ask(connection: socket.socket, request: dict[str, Any]) -> dict[str, Any]:
    """A client's side of one request."""
    raw = json.dumps(request).encode()
    connection.sendall(struct.pack(">I", len(raw)) + raw)
    return json.loads(receive(connection) or b"null")
