"""Fetching from a server of this process."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from plinth.sources import web

SEEN: list[str] = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        SEEN.append(self.path)
        again = self.path == "/busy" and SEEN.count("/busy") < 3
        self.send_response(503 if again else (404 if self.path == "/none" else 200))
        self.end_headers()
        self.wfile.write(b"page " + self.path.encode())

    def log_message(self, *args):
        return


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_retries(server):
    SEEN.clear()
    assert web.fetch(f"{server}/busy", pause=0)[:2] == (200, b"page /busy") and SEEN.count("/busy") == 3
    assert web.fetch(f"{server}/none", pause=0)[0] == 404 and SEEN.count("/none") == 1
    assert web.fetch("no address")[2] and web.fetch("http://127.0.0.1:9/", attempts=1)[1] is None


def test_source(spark, server):
    got = {r.url[len(server) :]: (r.status, r.content and bytes(r.content)) for r in web.read_pages(spark, [f"{server}/{i}" for i in range(5)] + [f"{server}/none"], partitions=3, pause=0).collect()}
    assert got == {f"/{i}": (200, f"page /{i}".encode()) for i in range(5)} | {"/none": (404, None)}
