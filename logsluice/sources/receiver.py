"""An HTTP receiver that lands payloads as files for the stream to read."""

from __future__ import annotations

import os
import socketserver
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from logsluice.errors import ParseError
from logsluice.functions.wire import STATUS
from logsluice.sources.otlp import parse

#: Connections served at a time; others wait to be accepted.
THREADS = 64


class Landing:
    """Numbered payload files in a folder; at most `capacity` are written at a time, others wait."""

    def __init__(self, folder: str, capacity: int = 8192) -> None:
        self.folder, self.lock, self.room = Path(folder), threading.Lock(), threading.BoundedSemaphore(capacity)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.next = 1 + max((int(p.stem) for p in self.folder.glob("*.otlp") if p.stem.isdigit()), default=-1)

    def put(self, payload: bytes) -> Path:
        with self.room:
            with self.lock:
                seq, self.next = self.next, self.next + 1
            path = self.folder / f"{seq:020d}.otlp"
            part = path.with_suffix(".tmp")
            part.write_bytes(payload)
            os.rename(part, path)
            return path


def verdict(payload: bytes, most: int) -> str:
    if len(payload) > most:
        return "too_large"
    try:
        parse(payload)
    except ParseError:
        return "malformed"
    return "accepted"


def accept(landing: Landing, payload: bytes, most: int) -> str:
    """Lands a payload, if it is one; the verdict. Only what is on disk is accepted."""
    what = verdict(payload, most)
    if what == "accepted":
        try:
            landing.put(payload)
        except OSError:
            what = "forward_failed"
    return what


class Bounded(socketserver.ThreadingMixIn):
    """A thread for each connection, up to a number of them: then new ones wait in the listen queue. Closing waits for those in work."""

    daemon_threads, block_on_close = False, True
    room: threading.BoundedSemaphore

    def process_request(self, request: object, client_address: object) -> None:
        self.room.acquire()
        super().process_request(request, client_address)

    def process_request_thread(self, request: object, client_address: object) -> None:
        try:
            super().process_request_thread(request, client_address)
        finally:
            self.room.release()


class Server(Bounded, HTTPServer):
    def __init__(self, address: tuple[str, int], handler: type, threads: int) -> None:
        self.room = threading.BoundedSemaphore(threads)
        super().__init__(address, handler)


class TooLarge(Exception):
    """A body beyond the limit."""


def serve(landing: Landing, host: str = "127.0.0.1", port: int = 4318, most: int = 4 << 20, threads: int = THREADS, idle: float = 30.0) -> Server:
    """A server (not yet running) that takes POST /v1/logs, with a length or in chunks.

    200; 400 malformed payload, length or chunk; 404 elsewhere; 411 neither length nor chunks; 413 too large; 501 another transfer coding; 503 not landed.
    """

    class Handler(BaseHTTPRequestHandler):
        protocol_version, timeout = "HTTP/1.1", idle

        def answer(self, status: int) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/x-protobuf")
            self.send_header("Content-Length", "0")
            if self.close_connection:
                self.send_header("Connection", "close")
            self.end_headers()

        def refuse(self, status: int) -> None:
            """An answer to a request whose body was not read to its end: the connection can't be used again."""
            self.close_connection = True
            self.answer(status)

        def exactly(self, n: int) -> bytes:
            data = self.rfile.read(n)
            if len(data) < n:
                raise ValueError("the body ends too early")
            return data

        def chunked(self) -> bytes:
            parts, size = [], 0
            while True:
                n = int(self.rfile.readline(1024).split(b";")[0].strip(), 16)
                if n < 0:
                    raise ValueError("a negative chunk")
                if n == 0:
                    while self.rfile.readline(8192) not in (b"\r\n", b"\n", b""):
                        pass
                    return b"".join(parts)
                if (size := size + n) > most:
                    raise TooLarge
                parts.append(self.exactly(n))
                if self.rfile.readline(8).strip():
                    raise ValueError("no end of a chunk")

        def body(self) -> bytes:
            if "Transfer-Encoding" in self.headers:
                return self.chunked()
            text = (self.headers.get("Content-Length") or "").strip()
            if not text.isascii() or not text.isdigit():
                raise ValueError(f"length {text!r}")
            if int(text) > most:
                raise TooLarge
            return self.exactly(int(text))

        def do_POST(self) -> None:
            coding = self.headers.get("Transfer-Encoding")
            if coding is None and self.headers.get("Content-Length") is None:
                return self.refuse(411)
            if coding is not None and coding.strip().lower() != "chunked":
                return self.refuse(501)
            if self.path != "/v1/logs":
                return self.refuse(404)
            try:
                payload = self.body()
            except TooLarge:
                return self.refuse(413)
            except (ValueError, OSError):
                return self.refuse(400)
            return self.answer(STATUS[accept(landing, payload, most)][0])

        def do_GET(self) -> None:
            self.refuse(404)

        do_PUT = do_DELETE = do_HEAD = do_GET

        def log_message(self, *args: object) -> None:
            pass

    return Server((host, port), Handler, threads)
