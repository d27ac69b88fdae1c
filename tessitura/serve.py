"""A small HTTP adapter on the driver: one Spark plan for each request, over a loaded library."""

from __future__ import annotations

import json
import resource
import signal
import sys
import threading
import time
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from tessitura.metrics import REQUEST_BOUNDS, gauge_text, number_text
from tessitura.operators.fingerprint import n_frames
from tessitura.sources.library import Library
from tessitura.sources.wav import WavError, decode

MAX_BODY, READ_SECONDS, DRAIN_SECONDS = 10 << 20, 30, 10


class Service:
    def __init__(self, spark: SparkSession, max_body: int = MAX_BODY):
        self.spark, self.max_body = spark, max_body
        self.library: Library | None = None
        self.loaded_at, self.songs = None, 0
        self.lock = threading.Lock()
        self.failed: str | None = None
        self.began = time.time()
        self.requests = {"ok": 0, "error": 0}
        self.buckets, self.sum = [0] * len(REQUEST_BOUNDS), 0.0

    def load(self, path: str) -> None:
        self.use(Library.load(self.spark, path))

    def load_later(self, path: str) -> threading.Thread:
        """Load in the background; until then the service is up but not ready, and stays so if it fails."""

        def run():
            try:
                self.load(path)
            except Exception as e:  # noqa: BLE001  kept for /readyz
                self.failed = str(e)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def close(self) -> None:
        library, self.library = self.library, None
        if library is not None:
            library.songs.unpersist()
            library.prints.unpersist()

    def use(self, library: Library) -> None:
        library.songs.cache()
        library.prints.cache()
        self.songs = library.songs.count()
        self.loaded_at, self.library = datetime.now(timezone.utc), library

    def match(self, body: bytes | None) -> tuple[int, dict]:
        began = time.perf_counter()
        status, out = self._match(body)
        took = time.perf_counter() - began
        with self.lock:
            self.requests["ok" if status == 200 else "error"] += 1
            if status == 200:
                self.sum += took
                self.buckets = [n + (took <= b) for n, b in zip(self.buckets, REQUEST_BOUNDS, strict=True)]
        return status, out | ({"elapsed_ms": int(took * 1000)} if status == 200 else {})

    def _match(self, body):
        library = self.library
        if library is None:
            return 503, {"error": "library not loaded"}
        if body is None:
            return 413, {"error": "clip too large"}
        try:
            rate, samples = decode(body)
        except WavError as e:
            return 400, {"error": str(e)}
        if n_frames(len(samples), library.params) == 0:
            return 400, {"error": "signal too short"}
        clip = self.spark.createDataFrame([(0, samples.tolist())], "sample_id long, samples array<double>")
        rows = library.match(clip, 5, rate).orderBy("rank").collect()  # five rows
        found = [{"name": r.name, "score": r.score, "votes": r.votes, "offset": r.offset} for r in rows]
        margin = found[0]["score"] / found[1]["score"] if len(found) > 1 and found[1]["score"] > 0 else 0
        return 200, {"matches": found, "margin": margin}

    def stats(self) -> tuple[int, dict]:
        if self.library is None:
            return 503, {"error": "library not loaded"}
        return 200, {"songs": self.songs, "loaded_at": self.loaded_at.strftime("%Y-%m-%dT%H:%M:%SZ"), **self.library.params.row()}

    def metrics(self) -> str:
        n = self.requests
        text = [_block("match_requests_total", "counter", "Match requests by status.", [f'{{status="{k}"}} {n[k]}' for k in sorted(n)])]
        buckets = [f'_bucket{{le="{number_text(b)}"}} {c}' for b, c in zip(REQUEST_BOUNDS, self.buckets, strict=True)]
        buckets += [f'_bucket{{le="+Inf"}} {n["ok"]}', f"_sum {number_text(self.sum)}", f"_count {n['ok']}"]
        text.append(_block("match_duration_seconds", "histogram", "Time of successful matches.", buckets))
        text.append(gauge_text("library_songs", "Songs in the library.", self.songs))
        text.append(gauge_text("library_loaded_timestamp_seconds", "When the library was loaded.", self.loaded_at.timestamp() if self.loaded_at else 0))
        return "".join(text) + runtime_text(self.began)


def _block(name: str, kind: str, help_text: str, lines: list[str]) -> str:
    return "\n".join([f"# HELP {name} {help_text}", f"# TYPE {name} {kind}", *(name + x for x in lines)]) + "\n"


def runtime_text(began: float) -> str:
    """Gauges of the driver's Python process."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    return "".join([
        gauge_text("process_threads", "Threads of the driver's Python process.", threading.active_count()),
        gauge_text("process_max_resident_bytes", "Largest resident size so far.", used.ru_maxrss * (1 if sys.platform == "darwin" else 1024)),
        gauge_text("process_cpu_seconds", "Processor time so far.", used.ru_utime + used.ru_stime),
        gauge_text("process_uptime_seconds", "Time since the start.", time.time() - began),
    ])


def handler(service: Service):
    class Handler(BaseHTTPRequestHandler):
        timeout = READ_SECONDS  # of the socket: slow clients are let go

        def _send(self, status: int, body, kind: str = "application/json"):
            raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):  # noqa: N802
            if self.path != "/v1/match":
                return self._send(404, {"error": "not found"})
            n = int(self.headers.get("Content-Length") or 0)
            try:
                self._send(*service.match(self.rfile.read(n) if n <= service.max_body else None))
            except Exception as e:  # noqa: BLE001  a request must not end the server
                self._send(500, {"error": str(e)})

        def do_GET(self):  # noqa: N802
            try:
                self._get()
            except Exception as e:  # noqa: BLE001  a request must not end the server
                self._send(500, {"error": str(e)})

        def _get(self):
            if self.path == "/v1/stats":
                self._send(*service.stats())
            elif self.path == "/healthz":
                self._send(200, {"status": "ok"})
            elif self.path == "/readyz":
                self._send(200 if service.library else 503, {"ready": service.library is not None} | ({"error": service.failed} if service.failed else {}))
            elif self.path == "/metrics":
                self._send(200, service.metrics(), "text/plain; version=0.0.4")
            else:
                self._send(404, {"error": "not found"})

        def log_message(self, *_):
            pass

    return Handler


class _Server(ThreadingHTTPServer):
    """Counts the requests under way, so that it can end when they have."""

    daemon_threads, block_on_close = True, False

    def __init__(self, *args):
        super().__init__(*args)
        self.busy, self.idle = 0, threading.Condition()

    def process_request_thread(self, request, address):
        with self.idle:
            self.busy += 1
        try:
            super().process_request_thread(request, address)
        finally:
            with self.idle:
                self.busy -= 1
                self.idle.notify_all()

    def drain(self, seconds: float = DRAIN_SECONDS) -> bool:
        """Take no more requests and wait for those under way; whether all have ended."""
        self.shutdown()
        self.server_close()
        with self.idle:
            return self.idle.wait_for(lambda: self.busy == 0, seconds)


def server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> _Server:
    return _Server((host, port), handler(service))


def run(service: Service, path: str, host: str = "0.0.0.0", port: int = 8080) -> None:
    """Serve until the process is told to end, then drain; the library is loaded in the background."""
    web = server(service, host, port)
    service.load_later(path)
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: threading.Thread(target=web.drain, daemon=True).start())
    web.serve_forever()
    with web.idle:
        web.idle.wait_for(lambda: web.busy == 0, DRAIN_SECONDS)
    service.close()
